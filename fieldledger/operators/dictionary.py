"""An inverted dictionary of phrases: surface forms found in texts by joins, not by patterns tried one by one.

A text is a row of words (letters and digits) with separators between them. At each word that can open a form, every run
of words as long as the longest form, written together without its separators, is looked up in a table of forms keyed the
same way; only the pairs that meet are compared as written. Work grows with the texts, not with texts times forms, and the table of forms is joined
by whatever means its size allows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_text
from ..sources.tables import settle

WORD, NOT_WORD = "[a-z0-9]+", "[^a-z0-9]+"
LARGEST = 23                   # a filter has at most two to the power of this many bits, 1 MB


def form_pattern(form: Column) -> Column:
    """Surface form as a pattern: loose spacing and hyphens, optional plural."""
    escaped = F.transform(F.split(F.trim(form), r"\s+"),
                          lambda w: F.regexp_replace(w, r"([.^$*+?{}\[\]\\|()])", r"\\$1"))
    return F.concat(F.lit(r"(?i)\b"), F.array_join(escaped, r"[\s-]*"), F.lit(r"s?\b"))


def form_index(forms: DataFrame) -> DataFrame:
    """Adds key, pattern and n_words to forms (form, and any other columns): one row for each spelling of the key,
    singular and plural. A form without a letter or digit has no key and is never found."""
    letters = F.regexp_replace(F.lower("form"), NOT_WORD, "")
    return (forms.withColumns({"pattern": form_pattern(F.col("form")),
                               "n_words": F.regexp_count(F.lower("form"), F.lit(WORD))})
            .where(letters != "").withColumn("key", F.explode(F.array(letters, F.concat(letters, F.lit("s"))))))


def longest(index: DataFrame) -> int:
    """Words of the longest form; 0 without forms."""
    return index.agg(F.max("n_words")).first()[0] or 0


def openings(index: DataFrame) -> DataFrame:
    """word: all that the first word of a form can be in a text, where words of the form may be written together."""
    words = F.regexp_extract_all(F.lower("form"), F.lit(WORD), F.lit(0))
    joined = F.transform("_words", lambda w, i: F.array_join(F.slice("_words", F.lit(1), i + 1), ""))
    return index.select("key", words.alias("_words")).select(
        F.explode(F.array_append(joined, F.col("key"))).alias("word")).distinct()


def bits_of(rows: DataFrame, column: str) -> DataFrame:
    """One row, bits: a filter of the values of a settled table, as longs of which each value sets a bit. Values outside
    pass at the share of bits set, at most a sixteenth below the LARGEST size; none of the values inside is missed."""
    size = min(LARGEST, max(10, (16 * rows.count()).bit_length()))
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << size) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(bit).alias("word"))
    every = rows.sparkSession.range(1 << (size - 6)).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("bits"))


def has_bit(bits: Column, value: Column) -> Column:
    """Whether the bit of a value is set."""
    at = F.xxhash64(value).bitwiseAND(F.size(bits).cast("long") * 64 - 1)
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def find_forms(texts: DataFrame, index: DataFrame, widest: int, text: str = "_text") -> DataFrame:
    """Every place of every form in normalised texts: the other columns of texts and of the index, at (number of the
    first word) and raw (as written). Null and empty texts and an empty index give nothing.

    Words that open a form, and then runs that are a key, are told in the row by filters of bits: only runs that pass are rows."""
    keep = [c for c in texts.columns if c != text]
    index = settle(index)
    opening, keyed = (F.broadcast(bits_of(r, c).withColumnRenamed("bits", "_bits")) for r, c in ((settle(openings(index)), "word"), (index, "key")))
    cut = texts.select(*keep, text, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words")).crossJoin(opening)
    near = F.array_compact(F.transform("_words", lambda w, i: F.when(has_bit(F.col("_bits"), w), i + 1)))
    opened = cut.select(*keep, text, "_words", near.alias("_at"))
    chunks = F.when(F.size("_at") > 0, F.regexp_extract_all(text, F.lit(f"{WORD}[^a-z0-9]*"), F.lit(0)))
    spans = F.flatten(F.transform("_at", lambda at: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(1, widest)), F.size("_words") - at + 1)),
        lambda n: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice("_words", at, n), "").alias("key")))))
    runs = opened.select(*keep, "_words", chunks.alias("_chunks"), spans.alias("_runs")).crossJoin(keyed)
    raw = F.transform(F.filter("_runs", lambda r: has_bit(F.col("_bits"), r["key"])), lambda r: F.struct(
        r["at"].alias("at"), r["key"].alias("key"), F.concat(
            F.array_join(F.slice("_chunks", r["at"], r["n"] - 1), ""), F.get("_words", r["at"] + r["n"] - 2)).alias("raw")))
    rows = runs.select(*keep, F.explode_outer(raw).alias("_s")).where(F.col("_s").isNotNull()).select(*keep, "_s.*")
    met = rows.join(index, "key")
    return met.where(F.regexp_like("raw", F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")))).drop("key", "pattern", "n_words")


def scan_forms(reports: DataFrame, forms: DataFrame, body: str = "body") -> DataFrame:
    """Every (category, subtype) of the forms present in a text, with the first match of its first form.

    forms: rank, form, category, subtype; a smaller rank comes first. Returns obs_id, seq (that rank), raw, category
    and subtype. Texts without a form give no row."""
    index = form_index(forms)
    texts = reports.where(F.col(body).isNotNull()).select("obs_id", normalize_text(F.col(body)).alias("_text"))
    first = F.min(F.struct("rank", "at", "raw")).alias("f")
    found = find_forms(texts, index, longest(index)).groupBy("obs_id", "category", "subtype").agg(first)
    return found.select("obs_id", F.col("f.rank").alias("seq"), "f.raw", "category", "subtype")
