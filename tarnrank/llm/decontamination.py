"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

One pass over the corpus stores the postings (document, position, term) of every term that a
benchmark item holds. Windows with a term that has no posting are out; for the others the lists of
their two rarest terms are intersected at adjusted offsets, which leaves alignments of an item with
a document; then the other terms of those windows are intersected at those alignments only, and runs
of matched terms as long as a window are exact phrase matches. Proximity matches are documents where
an item's two rarest terms stand within a distance of each other, in any order.

Terms are kept as 64-bit hashes; a window is only matched if all its terms' hashes match in place.
No word is reserved: what the index keeps of a document as such is a posting at position 0, whose
term is a number that no word gets.

Rows: null text has no words; empty tables give no matches; repeated rows are returned each time and
repeated items count once by their id; null document ids are kept, every other long is an id like
any other, and items with a null id are one item, as those with an empty one are. An item without words is ignored; one with fewer words
than a window is one window. Texts are whole; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WINDOW = 13
#: Rows, of two or three numbers each, up to which a counted side is broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of the posting that stands for a document itself; words never get it.
_DOCUMENT = 0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """The words of ``text``; an empty string stands first, or last, where a separator does."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _SEPARATORS, -1)


def _lead(words: Column) -> Column:
    """1 where the first word is an empty string."""
    return F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)


def _count(words: Column) -> Column:
    return F.greatest(F.lit(0), F.size(words) - _lead(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0))


def term(word: Column) -> Column:
    """A word's number, never that of a document's own posting."""
    h = F.xxhash64(word)
    return F.when(h == _DOCUMENT, 1).otherwise(h)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows``, which were counted, are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, version, q (place from 1), word, t (term), n (words of the item), w (words of its windows)."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), tokens(F.col(text_col)).alias("words"))
    words = words.select("item", F.slice("words", _lead(F.col("words")) + 1, _count(F.col("words"))).alias("words")).where("size(words) > 0").distinct()
    return words.select("item", F.size("words").alias("n"), F.xxhash64("words").alias("version"), F.posexplode("words").alias("q", "word")).select(
        "item", "version", (F.col("q") + 1).alias("q"), "word", term(F.col("word")).alias("t"), "n", F.least("n", F.lit(window)).alias("w")
    )


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Postings of ``terms`` (t) as a table: doc, version, missing, n_words, pos (from 1), t; at pos 0 each document itself.

    doc is 0 and missing true where the id is null; version, a hash of the text and of that, tells
    rows of one id apart. The scan is the only one of the corpus, and no text or unlisted term is
    shuffled if the terms are within the broadcast's bound.
    """
    text, missing = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).isNull()
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc"), F.when(missing, F.bitwise_not(F.xxhash64(text))).otherwise(F.xxhash64(text)).alias("version"), missing.alias("missing"), tokens(text).alias("words")
    )
    # the null in front is the document itself; a leading empty string falls on position 0 too, but is no term
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    rows = rows.select("doc", "version", "missing", _count(F.col("words")).alias("n_words"), _lead(F.col("words")).alias("lead"), F.posexplode(marked).alias("at", "word"))
    number = F.when(F.col("at") == 0, F.lit(_DOCUMENT).cast("long")).otherwise(term(F.col("word")))
    rows = rows.select("doc", "version", "missing", "n_words", F.greatest(F.lit(0), F.col("at") - F.col("lead")).alias("pos"), number.alias("t"))
    listed = terms.select("t").union(docs.sparkSession.range(1).select(F.lit(_DOCUMENT).cast("long").alias("t"))).distinct()
    return materialize(rows.join(small(listed, n_terms), "t", "left_semi"), path)


def frequencies(index: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` with f, the postings of each term (0 without one)."""
    counts = index.where("pos > 0").groupBy("t").agg(F.count("*").alias("f"))
    return items.join(counts, "t", "left").withColumn("f", F.coalesce("f", F.lit(0).cast("long")))


def alignments(index: DataFrame, known: DataFrame) -> DataFrame:
    """doc, version, item, iv, delta, spans: places where a window's two rarest terms both stand.

    ``known`` are items with frequencies. A term at place q of the item stands at position
    q + delta of the document; spans (lo, hi) are the places of the windows that hold both terms.
    """
    known = known.select("item", F.col("version").alias("iv"), "q", "t", "n", "w", "f")
    starts = F.sequence(F.greatest(F.lit(1), F.col("q") - F.col("w") + 1), F.least(F.col("q"), F.col("n") - F.col("w") + 1))
    windows = known.withColumn("s", F.explode(starts)).groupBy("item", "iv", "w", "s").agg(F.min("f").alias("low"), F.sort_array(F.collect_list(F.struct("f", "q", "t"))).alias("terms"))
    first, second = F.element_at("terms", 1), F.element_at("terms", F.least(F.lit(2), F.size("terms")))
    windows = windows.where("low > 0").select("item", "iv", "s", "w", first["t"].alias("t"), first["q"].alias("q1"), second["t"].alias("t2"), second["q"].alias("q2"))
    anchors = materialize(windows.groupBy("item", "iv", "t", "q1", "t2", "q2").agg(F.min("s").alias("lo"), F.max(F.col("s") + F.col("w") - 1).alias("hi")))
    n = anchors.count()
    rare = index.where("pos > 0").select("doc", "version", "pos", "t").join(small(anchors, n), "t")
    rare = rare.select("doc", "version", "item", "iv", (F.col("pos") - F.col("q1")).alias("delta"), (F.col("pos") - F.col("q1") + F.col("q2")).alias("pos"), F.col("t2").alias("t"), "lo", "hi")
    others = index.where("pos > 0").join(small(anchors.select(F.col("t2").alias("t")).distinct(), n), "t", "left_semi").select("doc", "version", "pos", "t")
    return rare.join(others, ["doc", "version", "pos", "t"], "left_semi").groupBy("doc", "version", "item", "iv", "delta").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def matches(index: DataFrame, items: DataFrame, n_terms: int, known: DataFrame | None = None) -> DataFrame:
    """doc, version, item, starts, w, delta: the places (from 1) where windows of an item stand."""
    found = materialize(alignments(index, frequencies(index, items) if known is None else known))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"]))))
    spread = found.select("doc", "version", "item", "iv", "delta", F.explode(places).alias("q"))
    wanted = spread.join(small(items.select("item", F.col("version").alias("iv"), "q", "t", "w"), n_terms), ["item", "iv", "q"])
    wanted = wanted.select("doc", "version", (F.col("q") + F.col("delta")).alias("pos"), "t", "item", "iv", "delta", "q", "w")
    # only documents with an alignment have their postings shuffled, where those documents are few
    aligned = found.select("doc", "version").distinct()
    n_aligned = aligned.count()
    postings = index.where("pos > 0").select("doc", "version", "pos", "t")
    if n_aligned <= BROADCAST_ROWS:
        postings = postings.join(F.broadcast(aligned), ["doc", "version"], "left_semi")
    met = postings.join(wanted, ["doc", "version", "pos", "t"])
    runs = met.groupBy("doc", "version", "item", "iv", "delta", "w").agg(F.sort_array(F.collect_set("q")).alias("qs"))
    # w ascending distinct places make a window if the last is w - 1 after the first
    whole = F.filter("qs", lambda q, i: F.get("qs", i + F.col("w") - 1) == q + F.col("w") - 1)
    return runs.select("doc", "version", "item", "w", "delta", F.transform(whole, lambda q: q + F.col("delta")).alias("starts")).where("size(starts) > 0")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, distance: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (ids as strings, sorted), contaminated, version.

    version is the hash of the text that tells apart rows of one id. With ``distance`` a column
    ``near`` follows: the items (sorted) with a proximity match within that many words, phrase or not.
    """
    items = materialize(item_terms(benchmark, item_col, item_text_col, window))
    n_terms = items.count()
    index = build_index(docs, items, n_terms, id_col, text_col)
    known = materialize(frequencies(index, items))
    found = materialize(matches(index, items, n_terms, known))
    spans = found.select("doc", "version", F.explode("starts").alias("s"), "w").distinct().withColumn("e", F.col("s") + F.col("w") - 1)
    # the union of spans: each adds what lies beyond all that start before it
    earlier = Window.partitionBy("doc", "version").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    added = spans.withColumn("reach", F.coalesce(F.max("e").over(earlier), F.lit(0))).select("doc", "version", F.greatest(F.lit(0), F.col("e") - F.greatest("reach", F.col("s") - 1)).cast("long").alias("n"))
    own = lambda df, name: df.groupBy("doc", "version").agg(F.sort_array(F.collect_set("item")).alias(name))
    out = index.where("pos = 0 and t = 0").select("doc", "version", "missing", F.col("n_words").cast("long").alias("n_words"))
    out = out.join(added.groupBy("doc", "version").agg(F.sum("n").alias("n_hit")), ["doc", "version"], "left").join(own(found, "items"), ["doc", "version"], "left")
    extra = []
    if distance is not None:
        out = out.join(own(near(index, rarest_pairs(known), distance).select("doc", "version", F.col("query").alias("item")), "near"), ["doc", "version"], "left")
        extra = [F.coalesce("near", F.array().cast("array<string>")).alias("near")]
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select(
        F.when(~F.col("missing"), F.col("doc")).alias(id_col), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.when(F.col("missing"), F.bitwise_not("version")).otherwise(F.col("version")).alias("version"), *extra,
    )


def rarest_pairs(known: DataFrame) -> DataFrame:
    """query (item), a, b: the two rarest different words of each item by ``f``, ties by the word; items with one word have none."""
    words = known.select("item", "f", "word").distinct().groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("f", "word"))), 1, 2).alias("own")).where("size(own) = 2")
    return words.select(F.col("item").alias("query"), F.col("own")[0]["word"].alias("a"), F.col("own")[1]["word"].alias("b"))


def near(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Proximity matches: query, doc, version, pos_a, pos_b for ``pairs`` (query, a, b: words) of the index.

    Positions are joined by buckets of ``distance`` and their neighbours, an equi-join.
    """
    width, postings = distance + 1, index.where("pos > 0").select("doc", "version", "pos", "t")
    pairs = materialize(pairs.select("query", term(F.col("a")).alias("t"), term(F.col("b")).alias("tb")))
    n = pairs.count()
    left = postings.join(small(pairs, n), "t")
    left = left.select("query", "doc", "version", F.col("pos").alias("pos_a"), F.col("tb").alias("t"), F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("bucket"))
    right = postings.join(small(pairs.select(F.col("tb").alias("t")).distinct(), n), "t", "left_semi").select("doc", "version", "t", F.col("pos").alias("pos_b"), F.floor(F.col("pos") / width).alias("bucket"))
    return left.join(right, ["doc", "version", "t", "bucket"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= distance) & (F.col("pos_a") != F.col("pos_b"))).select("query", "doc", "version", "pos_a", "pos_b")
