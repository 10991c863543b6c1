"""Operators without Spark: formats, parsers, tokenizers, heuristics."""

import collections
import html.parser
import math
import os
import random
import struct
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import extraction, mpegts, neardup, packing, quality_model, textops, warc


def spans(texts):
    for at, data, bounds in textops.utf8_batches(pa.array(texts, pa.string()), 50):
        yield texts[at : at + len(bounds) - 1], data, bounds


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\t\n\x0b ", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_shingles_are_those_of_a_plain_loop(texts, n):
    seen = {}
    for part, data, bounds in spans(texts):
        h, first = textops.shingle_sets(data, bounds, n)
        for k, text in enumerate(part):
            words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall("[^ \t-\r]+", text)]
            want = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
            got = set(h[first[k] : first[k + 1]].tolist())
            assert len(got) == first[k + 1] - first[k] == len(want)
            key = frozenset(want)
            assert seen.setdefault(key, got) == got


def test_shingles_of_nothing():
    h, first = textops.shingle_sets(np.empty(0, np.uint8), np.array([0, 0, 0]), 3)
    assert len(h) == 0 and first.tolist() == [0, 0, 0]
    assert list(textops.utf8_batches(pa.array([None, ""], pa.string())))[0][2].tolist() == [0, 0, 0]


def test_least_matches_is_a_tail():
    t = neardup.least_matches(48, 0.85)
    assert 20 < t < 41 and neardup.least_matches(48, 1.0) == 48
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64)
    other = np.sort(np.concatenate([base[:920], rng.integers(0, 2**64 - 1, 80, dtype=np.uint64)]))
    sig = neardup.minhash(np.concatenate([np.sort(base), other]), np.array([0, 1000, 2000]), 48)
    assert t <= int((sig[0] == sig[1]).sum()) < 48


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return packing.RunTokenizer(TOKENIZER, cache_runs=500), Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, texts):
    out = []
    for _, data, bounds in spans(texts):
        ids, first = tokenizer.encode(data, bounds)
        out += [ids[first[i] : first[i + 1]].tolist() for i in range(len(first) - 1)]
    return out


CASES = ["Hello  WORLD's don't été é ́x <|endoftext|> a<|endoftext|>b 12345 日本語 ΣΑΣ\tfoo\x1cbar z <|ENDOFTEXT|>", "ÀÉÎ ª º µ x÷y ñ!! ''s 's foo's... a-b `q` \xa0x ﬁ İ Ã Ã", " ", "", "a\nb", "x" * 9000 + " " + "é" * 3000]


def test_runs_give_the_tokenizers_ids(both):
    assert ids_of(both[0], CASES) == [both[1].encode(x, add_special_tokens=False).ids for x in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abÀß×÷éÉ'!<|>0 \ńΩ", max_size=40)), min_size=1, max_size=5))
def test_runs_give_the_tokenizers_ids_always(both, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(both[0], texts) == [both[1].encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(0, 64)), min_size=1, max_size=80), st.integers(1, 6), st.integers(16, 64))
def test_packing_keeps_all_limits(rows, most, loss_cap):
    tokens, loss = np.array([r[0] for r in rows]), np.array([min(r) for r in rows])
    sequence, offset, order = packing.place(tokens, loss, (64, most, loss_cap))
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(order[own])]
        assert len(own) <= most and tokens[own].sum() <= 64
        assert loss[own].sum() <= loss_cap or len(own) == 1
        assert offset[own].tolist() == (np.cumsum(tokens[own]) - tokens[own]).tolist() and order[own].tolist() == list(range(len(own)))


def plain_packing(tokens, loss, limits):
    """The heuristic by plain loops: the piece of the largest dot product that fits; ties to the shorter, then the earlier."""
    need = [tokens.sum() / limits[0], len(tokens) / limits[1], loss.sum() / limits[2]]
    need = [x / sum(need) for x in need]
    open_, out, number = sorted(range(len(tokens)), key=lambda i: (tokens[i], loss[i], i)), {}, 0
    while open_:
        left = list(limits)
        while True:
            fitting = [i for i in open_ if tokens[i] <= left[0] and left[1] >= 1 and loss[i] <= left[2]]
            if not fitting:
                break
            best = max(fitting, key=lambda i: (round(sum(w * d * r / c**2 for w, d, r, c in zip(need, (tokens[i], 1, loss[i]), left, limits)), 12), -open_.index(i)))
            out[best] = number
            open_.remove(best)
            left = [left[0] - tokens[best], left[1] - 1, left[2] - loss[best]]
        number += 1
    return [out[i] for i in range(len(tokens))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40), st.integers(1, 6), st.integers(63, 64))
def test_packing_is_that_of_a_plain_loop(sizes, most, loss_cap):
    tokens = np.array(sorted(sizes))
    assert packing.place(tokens, tokens - 1, (64, most, loss_cap))[0].tolist() == plain_packing(tokens, tokens - 1, (64, most, loss_cap))


def test_each_limit_stops_what_the_others_allow():
    def most(tokens, loss, limits):
        sequence = packing.place(np.array(tokens), np.array(loss), limits)[0]
        return max(collections.Counter(sequence.tolist()).values())

    assert most([16] * 9, [1] * 9, (64, 9, 64)) == 4  # tokens
    assert most([2] * 9, [1] * 9, (64, 5, 64)) == 5  # segments
    assert most([16] * 9, [15] * 9, (64, 9, 50)) == 3  # loss-bearing tokens
    limits = (packing.CAPACITY, packing.MAX_SEGMENTS, int(packing.CAPACITY * packing.LOSS_SHARE))
    assert most([3] * 500, [2] * 500, limits) == packing.MAX_SEGMENTS
    assert most([1024] * 8, [1023] * 8, limits) == 1 and most([1024] * 8, [0] * 8, limits) == 2


@pytest.mark.parametrize("n", [0, 1, 162, 163, 169, 170, 171, 176, 177, 184, 185, 7680, 7681, 7680 * 13 + 5])
def test_transport_round_trip(n):
    payload = os.urandom(n)
    stream = mpegts.mux(payload)
    got = mpegts.demux(stream)
    assert len(stream) % 188 == 0 and got["payload"] == payload and got["breaks"] == 0
    assert [u[1] for u in got["units"]] == [k * mpegts.TICKS for k in range(-(-n // mpegts.UNIT_BYTES))]
    assert [k for k, u in enumerate(got["units"]) if u[4]] == list(range(0, len(got["units"]), mpegts.POINT_EVERY))


def test_transport_damage():
    payload = os.urandom(40_000)
    stream = mpegts.mux(payload)
    assert mpegts.demux(b"xx\x47junk" + stream)["payload"] == payload
    lost = stream[: 188 * 9] + stream[188 * 10 :]
    assert mpegts.demux(lost)["breaks"] == 1
    twice = stream[: 188 * 9] + stream[188 * 8 : 188 * 9] + stream[188 * 9 :]
    assert mpegts.demux(twice)["breaks"] == 0 and mpegts.demux(twice)["payload"] == payload
    broken = bytearray(stream)
    broken[10] ^= 1  # the association table's CRC no longer holds
    programs = mpegts.demux(bytes(broken))["programs"]
    assert programs in ({}, {1: {256: 6}})  # only if the table comes again
    assert mpegts.demux(b"") == {"programs": {}, "packets": 0, "breaks": 0, "payload": b"", "units": []}
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_padding():
    assert [len(mpegts.padded(b"x" * n)) for n in (0, 1, 192, 193)] == [192, 192, 192, 384]


def test_warc_round_trip():
    records = [warc.record(k, f"http://x/{k}", os.urandom(k * 37)) for k in range(20)] + [warc.record(30, "http://y\r\nX: 1", b"abc", 3, "http://x/3")]
    archive = warc.write_archive(records)
    assert struct.unpack("<I", archive[:4])[0] == 0x184D2A5D
    got = list(warc.read_archive(archive))
    assert [f["WARC-Record-ID"] for f, _ in got] == [f"<urn:page:{k}>" for k in (*range(20), 30)]
    assert [len(warc.http_payload(b)) for _, b in got[:20]] == [k * 37 for k in range(20)]
    assert got[20][0]["WARC-Type"] == "revisit" and got[20][0]["WARC-Refers-To"] == "<urn:page:3>" and "X" not in got[20][0]
    assert list(warc.read_archive(b"")) == []


def test_warc_faults():
    good = warc.record(1, "u", b"payload")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 8", b"Content-Length: 9"), good.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n")):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    archive = warc.write_archive([good] * 8)
    for cut in (archive[:-3], archive[:20], archive + b"zzzz", archive[:-30] + b"\x00" * 30):
        with pytest.raises(warc.BadRecord):
            list(warc.read_archive(cut))


def test_archives_of_others_are_read():
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nwarc-record-id: <urn:uuid:a-b>\r\nwarc-date: 2020-01-01T00:00:00Z\r\ncontent-length: 4\r\ncontent-type: application/warc-fields\r\n\r\na: b\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    page = b"WARC/1.1\r\nWARC-TYPE: response\r\nWARC-Record-ID: <urn:uuid:c>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    again = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:d>\r\nWARC-Refers-To: <urn:uuid:c>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [warc._row(*x) for x in warc.read_archive(warc.write_archive([info, page, again]))]
    assert rows[0] == (None, None, 4, warc.digest(b"a: b"), "warcinfo", None, b"a: b", "<urn:uuid:a-b>", None)
    assert rows[1][2:5] == (5, "sha256:00", "response") and rows[1][6] == b"hello"
    assert rows[2][2:] == (None, None, "revisit", None, None, "<urn:uuid:d>", "<urn:uuid:c>")
    wrong = page.replace(b"sha256:00", b"sha1:" + b"0" * 40)
    with pytest.raises(warc.BadRecord):
        warc._row(*warc.parse_record(wrong))


def test_frames_end_where_their_blocks_do():
    import zstandard

    for size in (0, 10, 100_000, 3_000_000):
        for checksum in (True, False):
            frame = zstandard.ZstdCompressor(write_checksum=checksum).compress(os.urandom(size // 2) + b"a" * (size // 2))
            assert warc.frame_end(frame + b"more", 0) == len(frame)


ARTICLE = "First para, with words & punctuation. It is long enough, I think, to count.\nSecond para a < b — c, with more words than needed. Truly."


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


PROSE = "<p>First para, with words &amp; punctuation. It is long enough, I think, to count.</p><p>Second&nbsp;para <b>a</b> &lt; b &#8212; c, with\n more words than needed. Truly.</p>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{PROSE}</article>",
        f"<nav><ul><li><a href=x>Menu</a></ul></nav><div id=main><div class='post'>{PROSE}</div></div><footer>(c) us</footer>",
        f"<header><h1>Site</h1></header><main>{PROSE}<aside><p>Related things, many things, here, and there.</p></aside></main>",
        f"<div class='cookie-notice'><p>We use cookies, ok? We do, really, all of them.</p></div><article>{PROSE}<form><p>Your mail, please.</p><input></form></article>",
        f"<article>{PROSE}<section class='comments'><article class=comment><p>Great post, I liked it, a lot. Thanks, really!</p></article></section></article>",
        f"<script>var a='<p>no</p>';</script><article>{PROSE}<!-- <p>hidden</p> --><noscript><p>Enable it, please.</p></noscript></article>",
        f"<div class='ad'>Buy, now!</div><article>{PROSE}<div hidden><p>Unseen, all of it.</p></div><div style='display:none'>no</div></article>",
        f"<div role=navigation><a href=x>One</a> <a href=y>Two</a></div><div class=content>{PROSE}</div><div class='sidebar'><p>Side text, with commas, and more.</p></div>",
    ],
)
def test_article_only(body):
    assert extraction.main_text(page(body)) == ARTICLE


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("<p>a<p>b <i>c</i>d<script>x<p></script>e<br>g 1 < 2", "a\nb cde g 1 < 2"), ("plain &amp; text", "plain & text"), ("<div><script>never closed", ""), ("<p title='a>b'>x</p>", "x")])
def test_odd_pages(html, want):
    assert extraction.main_text(html) == want


def test_headings_and_lists_stay():
    body = f"<article><h1>Title</h1>{PROSE}<h2>Short</h2><ul><li>one<li>two</ul><blockquote>Quote me.</blockquote></article>"
    assert extraction.main_text(page(body)) == f"Title\n{ARTICLE}\nShort\none\ntwo\nQuote me."


def test_deep_and_long_pages_are_read_in_one_pass():
    began = time.process_time()
    assert extraction.main_text("<div>" * 3000 + "x, y." + "</div>" * 3000) == "x, y."
    assert len(extraction.main_text("<article>" + "<p>word, word.</p>" * 20_000 + "</article>").split("\n")) == 20_000
    assert len(extraction.main_text("<div>x, y." * 100_000).split("\n")) == 100_000
    assert extraction.main_text("<span>x, y." * 100_000).startswith("x, y.x, y.")
    assert extraction.main_text("<p>" + "word, " * 200_000).count("word") == 200_000
    assert time.process_time() - began < 8


LINES = "<p>First long paragraph, with words and, of course, commas. It goes on.</p><p>Second long paragraph, with words and, of course, commas. It goes on.</p>"


@pytest.mark.parametrize("wrap", ["<section id='follow-up'>{}</section>", "<section class='popular-science'>{}</section>", "<div class='print-summary'>{}</div>", "<div class='side-effects'>{}</div>", "<div class='related-work'>{}</div>", "<div id='footnotes'>{}</div>"])
def test_names_of_an_articles_parts_lose_nothing(wrap):
    assert extraction.main_text(page(f"<article>{LINES}{wrap.format(LINES)}{LINES}</article>")).count("long paragraph") == 6
    assert extraction.main_text(page(f"<div>{LINES}{wrap.format(LINES)}{LINES}</div>")).count("long paragraph") == 6


def test_the_ratios_decide_without_articles_or_names():
    menu = "".join(f"<div class=x{k % 3}><a href=/{k}>Item {k}</a></div>" for k in range(9))
    html = page(f"<div>{menu}</div><div><h2>Title</h2>{LINES * 3}</div><div class=z><span>Short label</span></div>")
    assert extraction.main_text(html) == "Title\n" + "\n".join(["First long paragraph, with words and, of course, commas. It goes on.", "Second long paragraph, with words and, of course, commas. It goes on."] * 3)


def test_other_ratios_choose_other_nodes(monkeypatch):
    html = page(f"<div class='ad'>Buy it now.</div><article>{LINES}</article>")
    monkeypatch.setattr(extraction, "path_scores", lambda p: {b.path: 1.0 for b in p.blocks})
    assert extraction.main_text(html).startswith("Buy it now.\nFirst long")


class Plain(html.parser.HTMLParser):
    """Blocks of well-formed pages of div, p, h2, article and a: (path of (name.class, number), text, in links)."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.n, self.link = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.n += 1
        self.stack.append((f"{tag}.{dict(attrs).get('class', '')}", self.n))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.stack.pop()

    def handle_data(self, data):
        self.blocks.append((list(self.stack), data, len(data) if self.link else 0))


def plain_main_text(source):
    parser = Plain()
    parser.feed(source)
    blocks = [(tuple(x for x, _ in stack), [n for _, n in stack], text, linked) for stack, text, linked in parser.blocks]
    paths = list(dict.fromkeys(b[0] for b in blocks))
    mean = lambda xs: sum(xs) / len(xs)
    of = {p: [b for b in blocks if b[0] == p] for p in paths}
    texts = [mean([len(b[2]) - b[3] for b in of[p]]) for p in paths]
    marks = [(sum(sum(c in ".,;:!?" for c in b[2]) for b in of[p] if not b[3]) + 0.1) / len(of[p]) for p in paths]

    def smooth(values, i):
        near = [(math.exp(-((i - j) ** 2) / 2) * len(of[paths[j]]), values[j]) for j in range(len(paths)) if abs(i - j) <= 2]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    article = lambda p: any(x.startswith("article") for x in p)
    score = {}
    for i, p in enumerate(paths):
        score[p] = math.sqrt(texts[i] * marks[i] * smooth(texts, i) * smooth(marks, i))
        score[p] *= 0.15 ** sum(x == "div.ad" for x in p) * 0.15 ** max(0, sum(x.startswith("article") for x in p) - 1)
        score[p] *= 0.02 if any(map(article, paths)) and not article(p) else 1
    bar = 0.25 * sum(score[b[0]] * len(b[2]) for b in blocks) / sum(len(b[2]) for b in blocks)
    chosen = {p for p in paths if score[p] >= bar} or set(paths)
    content = [b[0] in chosen for b in blocks]
    nodes = [list(zip(b[1], b[0])) for b, c in zip(blocks, content) if c]
    common = [x for x in nodes[0] if all(x in other for other in nodes)]
    while common and common[-1][1].split(".")[0] in ("p", "h2"):
        common.pop()
    root = common[-1] if common else None
    first, last = content.index(True), max(i for i, c in enumerate(content) if c)
    bad = lambda p: "div.ad" in p or sum(x.startswith("article") for x in p) > 1
    while first and blocks[first - 1][0] and blocks[first - 1][0][-1].startswith("h2") and not bad(blocks[first - 1][0]):
        first -= 1
    beside = {tuple(b[1][:-1]) for b, c in zip(blocks, content) if c}
    out = []
    for i, (b, c) in enumerate(zip(blocks, content)):
        joins = (root is None or root in zip(b[1], b[0])) and not bad(b[0])
        if not (root and root[1].startswith("article")):
            joins = joins and first <= i <= last and 2 * b[3] <= len(b[2]) and (b[0][-1].startswith("h2") or tuple(b[1][:-1]) in beside)
        if c or joins:
            out.append(b[2])
    return "\n".join(out)


_text = st.sampled_from(["Short", "A label here", "Some words, and more of them, in a row. They end here.", "Long prose, with commas, and clauses; and so on, and on. It ends, at last, here.", "x"])
_leaf = st.one_of(_text.map(lambda t: f"<p>{t}</p>"), _text.map(lambda t: f"<h2>{t}</h2>"), _text.map(lambda t: f"<p class=b>{t}</p>"), _text.map(lambda t: f"<p class=m><a>{t}</a></p>"))
_tree = st.recursive(_leaf, lambda inner: st.tuples(st.sampled_from(["div", "div class=ad", "div class=c", "article"]), st.lists(inner, min_size=1, max_size=4)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0].split()[0]}>"), max_leaves=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(_tree, min_size=1, max_size=4).map("".join))
def test_extraction_is_that_of_a_plain_version(source):
    assert extraction.main_text(source) == plain_main_text(source)


def test_network_learns_and_blocks_agree():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for k in range(240):
        words = [word() for _ in range(rng.randint(5, 80))]
        if k % 2:
            words = [w + "***" for w in words]
        texts.append(" ".join(words).encode())
        labels.append(1 - k % 2)
    net = quality_model.fit(texts[:160], labels[:160], 0.5, epochs=4, least_steps=20)
    data, bounds = np.frombuffer(b"".join(texts[160:]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[160:]])])
    got = net.scores(data, bounds)
    assert ((got > 0.5) == np.array(labels[160:])).mean() > 0.95
    one = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts[160:]]
    assert np.allclose(got, one, atol=1e-5)
    assert net.scores(np.empty(0, np.uint8), np.array([0, 0, 0])).shape == (2,)


def plain_score(net, text):
    """Convolution, pooling and score of one text by loops."""
    size = max(2, -(-len(text) // 8)) * 8
    data = list(text) + [256] * (size - len(text))
    half = 8 * quality_model.DIMS + quality_model.LAGS
    blocks = []
    for b in range(0, size, 8):
        lags = [sum(data[i] == data[i - lag] != 256 for i in range(b, b + 8) if i >= lag) / 8 for lag in range(1, quality_model.LAGS + 1)]
        blocks.append([float(v) for i in range(b, b + 8) for v in net.embed[data[i]]] + lags)
    best = [-math.inf] * quality_model.FILTERS
    for left, right in zip(blocks, blocks[1:]):
        for f in range(quality_model.FILTERS):
            best[f] = max(best[f], float(np.dot(left, net.filters[:half, f]) + np.dot(right, net.filters[half:, f]) + net.bias[f]))
    z = sum(max(b, 0) * float(o) for b, o in zip(best, net.out)) + net.out_bias
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_loops():
    net = quality_model.fit([b"abc d" * 20, b"*** x x x" * 20] * 20, [1, 0] * 20, 0.3, epochs=1, least_steps=3)
    texts = [b"", b"x", b"abcdefgh", b"word word word word " * 5, os.urandom(200), "é è ç".encode() * 9, b"ab" * 40]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert net.scores(data, bounds) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_long_texts_are_pooled_piece_by_piece(monkeypatch):
    net = quality_model.fit([b"abc " * 20, b"*** " * 20] * 20, [1, 0] * 20, 0.5, epochs=1, least_steps=1)
    text = np.frombuffer(os.urandom(9_000) + b"repeat this now " * 100 + os.urandom(9_001), np.uint8)
    whole = net.pooled(text, np.array([0, len(text)]))
    monkeypatch.setattr(quality_model, "BLOCK_BYTES", 800)
    assert np.allclose(whole, net.pooled(text, np.array([0, len(text)])), atol=1e-5)


def _two_programs():
    """Two association sections, maps of both programs on one PID, and a later map that adds a stream to the first."""
    import struct

    from siftline.llm import mpegts as m

    def pes(pid, data):
        one = b"\x00\x00\x01\xbd" + struct.pack(">H", len(data) + 3) + b"\x84\x00\x00" + data
        gap = m.PACKET - 4 - len(one)
        return struct.pack(">BHBBB", m.SYNC, 0x4000 | pid, 0x30, gap - 1, 0) + b"\xff" * (gap - 2) + one

    def pmt(number, *streams):
        return m._section(2, number, struct.pack(">HH", 0xE000 | 0x200, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE000 | es, 0xF000) for es in streams))

    pat = [m._section(0, 1, struct.pack(">HH", n, 0xE000 | 0x100)) for n in (1, 2)]
    tables = [m._table_packet(0, 0, pat[0]), m._table_packet(0, 1, pat[1]), m._table_packet(0x100, 0, pmt(1, 0x201)), m._table_packet(0x100, 1, pmt(2, 0x202)), m._table_packet(0x100, 2, pmt(1, 0x201, 0x203))]
    return b"".join(tables + [pes(0x201, b"one"), pes(0x202, b"two"), pes(0x203, b"three")])


def test_all_programs_and_later_maps_are_read():
    from siftline.llm import mpegts as m

    got = m.demux(_two_programs())
    assert got["programs"] == {1: {0x201: 6, 0x203: 6}, 2: {0x202: 6}} and got["payload"] == b"onetwothree"


def test_a_section_that_ends_before_the_pointer_is_read():
    import struct

    import numpy as np

    from siftline.llm import mpegts as m

    first, second = m._section(0, 1, bytes(200)), m._section(0, 1, b"\x00\x07\xe1\x00")
    packets = struct.pack(">BHB", m.SYNC, 0x4000, 0x10) + b"\x00" + first[:183] + (struct.pack(">BHB", m.SYNC, 0x4000, 0x11) + bytes([len(first) - 183]) + first[183:] + second).ljust(m.PACKET, b"\xff")
    assert m._sections(np.frombuffer(packets, np.uint8).reshape(2, m.PACKET), 0) == [(1, bytes(200)), (1, b"\x00\x07\xe1\x00")]
