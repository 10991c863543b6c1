"""Text analysis as Column expressions: normal forms, tokens, slices, buckets, glued "key value" strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zа-я0-9]+"


def normalize(c: Column) -> Column:
    """Lower case, with ё as е; null as empty."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def norm_text(c: Column) -> Column:
    """The form in which texts count as equal: tokens with single spaces."""
    return F.trim(F.regexp_replace(normalize(c), "[^0-9a-zа-я]+", " "))


def char_slice(c: Column, start: int, stop: int) -> Column:
    """Characters start to stop (not included), counted from 0."""
    return F.substring(F.coalesce(c, F.lit("")), start + 1, stop - start)


def n_words(c: Column) -> Column:
    """Parts between single spaces; an empty text has one."""
    return F.size(F.split(norm_text(c), " "))


def words_bucket(n: Column) -> Column:
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def frequency_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 8, "4-8").when(n <= 30, "9-30").otherwise("31+")


def relevant_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def reviews_bucket(n: Column) -> Column:
    """Null counts as many."""
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 50, "11-50").otherwise("51+")


def document_text(title: Column, params: Column, description: Column) -> Column:
    """The weighted text of an item: its title twice, 600 characters of parameters, 1500 of description."""
    e = F.lit("")
    return F.concat_ws(" ", F.coalesce(title, e), F.coalesce(title, e), char_slice(params, 0, 600), char_slice(description, 0, 1500))


def safe_number(c: Column, fill: float = 0.0) -> Column:
    """A number, or ``fill`` where there is none to read."""
    return F.coalesce(c.try_cast("double"), F.lit(fill))


def is_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def phrase_in(needle: Column, text: Column) -> Column:
    """1 if the trimmed, normalised phrase isn't empty and occurs in the text."""
    n = F.trim(normalize(needle))
    return ((n != "") & F.contains(normalize(text), n)).cast("int")


def extract_field(raw: Column, label: str, stops: list[str], drop: list[str] = (), most: int = 8) -> Column:
    """Up to ``most`` distinct values that follow ``label`` and end before one of ``stops`` or at the text's end."""
    ends = "|".join(rf"\s{s}\s" for s in stops)
    found = F.regexp_extract_all(raw, F.lit(rf"{label}\s+(.+?)(?={ends}|$)"), F.lit(1))
    clean = F.array_distinct(F.transform(found, lambda x: F.btrim(x, F.lit(" .,;:"))))
    return F.slice(F.filter(clean, lambda x: (x != "") & ~x.isin(list(drop)) if drop else x != ""), 1, most)


def city_of(place: Column, region: str, street: str) -> Column:
    """The first part of an address between commas that looks neither like a region nor like a street; else empty."""
    parts = F.transform(F.split(F.coalesce(place, F.lit("")), ","), lambda x: F.trim(x))
    return F.coalesce(F.get(F.filter(parts, lambda p: (p != "") & ~p.rlike(region) & ~p.rlike(street)), 0), F.lit(""))


def experience_years(c: Column) -> Column:
    """Half a year for "Меньше ..." (less), the middle of a range, or the number; null if there is none."""
    v = F.trim(c)
    a, b = (F.regexp_extract(v, r"^(\d+)\s*[–-]\s*(\d+)", k) for k in (1, 2))
    n = F.regexp_extract(v, r"^(\d+)", 1)
    return F.when(v.startswith("Меньше"), 0.5).when(a != "", (a.try_cast("double") + b.try_cast("double")) / 2).when(n != "", n.try_cast("double"))


def short_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def prefixed_bag(stems: Column, lemmas: Column) -> Column:
    """Stems and lemmas in one bag, told apart by a prefix."""
    return F.concat(F.transform(stems, lambda x: F.concat(F.lit("s:"), x)), F.transform(lemmas, lambda x: F.concat(F.lit("l:"), x)))


def item_variants(title: Column, params: Column, description: Column) -> dict[str, Column]:
    """The texts of an item for an encoder: its title; with its parameters, if it has any; with the description's start.

    The parsed variants (t2p, t3p) are these with the item's core text, cut to 500 characters, for ``params``."""
    t, p, d = (F.coalesce(c, F.lit("")) for c in (title, params, description))
    return {"t1": t, "t2": F.when(p == "", t).otherwise(F.concat(t, F.lit(". "), p)), "t3": F.concat(t, F.lit(". "), p, F.lit(". "), F.substring(d, 1, 300))}


def query_variants(query: Column, filters: Column, city: Column) -> dict[str, Column]:
    """The texts of a query for an encoder: alone, with its filters, with its city (null if unknown), with both."""
    q, f = F.coalesce(query, F.lit("")), F.coalesce(filters, F.lit(""))
    filtered = F.when(f == "", q).otherwise(F.concat(q, F.lit(". "), f))
    at = F.coalesce(F.concat(F.lit(". Город: "), city), F.lit(""))
    return {"plain": q, "filters": filtered, "city": F.concat(q, at), "filters_city": F.concat(filtered, at)}


# --- fixed values: what encoders were trained to see before a text, by family, for queries and for items -------------
PROMPTS = {
    "e5": ("query: ", "passage: "),
    "frida": ("search_query: ", "search_document: "),
    "qwen3": ("Instruct: Retrieve Russian service ads that satisfy the user search.\nQuery: ", ""),
}
# --------------------------------------------------------------------------------------------------------------------


def prompt(model: str, text: Column, is_query: bool) -> Column:
    """A text with its model's prefix; the family is the name's part before the first underscore."""
    prefix = PROMPTS.get(model.split("_")[0], ("", ""))[0 if is_query else 1]
    return F.concat(F.lit(prefix), text) if prefix else text
