"""Quality rules (1): frequency of lines across the documents of a host.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, durable, let, narrow, words_of

#: A line that more documents of its host hold is removed: more than so many, and than so many in a thousand of the host's documents.
MAX_DOCS, MAX_SHARE = 40, 30
#: A document that keeps a smaller share of its words is rejected.
MIN_KEPT = 0.4
#: Rows of frequent lines (16 bytes each) up to which the table goes to all executors; beyond it, a shuffled join.
BROADCAST_ROWS = 250_000

MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE_RUN, " "))


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three words that the text has twice or more.

    Sorts the hashes of a text's windows with their places, so equal ones are neighbours; only texts with a repeated hash
    get that far.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def places(s: Column) -> Column:
        equal = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"]))
        return F.array_sort(F.transform(equal, lambda j: F.get(s, j)["i"]))

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(let(by_hash, places)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, max_share: int = MAX_SHARE
) -> DataFrame:
    """One row per row of ``docs``: its base figures, its words in frequent lines, the verdict and the text without those lines.

    A line's hash is that of its normalised form; lines without a word don't count.  A line is frequent if more than
    ``max_docs`` distinct documents of one host hold it, and more than ``max_share`` in a thousand of them; a document is an id with a text, so
    copies under ids of their own count each.  Hashes and counts
    are combined before each shuffle, and a common line is spread by its documents.  Columns: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept, clean_text.

    A null text is an empty one (no words, so base_failed); null hosts are one host; rows with the same id, host and text
    get the same verdict, each its own row; an empty table gives an empty one; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, doc_id=id_col, text=text_col, host=host_col)
    keyed = rows.select("doc_id", text.alias("text"), F.xxhash64(F.col("host"), F.col("host").isNull()).alias("host")).withColumns(
        {"k1": F.xxhash64("doc_id", "host", "text"), "k2": F.xxhash64("text", F.lit(1), "host", F.col("doc_id").isNull(), "doc_id")}
    )

    hashes = F.transform(lines_with_words(F.col("text")), lambda x: F.xxhash64(normalised(x)))
    # Beside its lines, each document has a null: how many documents the host has comes out of the same pass.
    seen = keyed.select("host", "k1", F.explode(F.concat(F.array_distinct(hashes), F.array(F.lit(None).cast("long")))).alias("line"))
    counted = seen.groupBy("host", "line").agg(F.countDistinct("k1").alias("n")).filter((F.col("n") > max_docs) | F.col("line").isNull())
    # Few rows are left: they are dealt out anew, so that all tasks count and few write.
    counted = durable(counted.repartition(docs.sparkSession.sparkContext.defaultParallelism), "lines")
    hosts = counted.filter("line IS NULL").select("host", F.col("n").alias("all"))
    frequent = counted.filter("line IS NOT NULL").join(hosts, "host").filter(1000 * F.col("n") > max_share * F.col("all")).select("host", "line")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)

    has_word = F.length(F.translate(F.col("raw"), SPACES, "")) > 0
    lines = keyed.select("k1", "k2", "host", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).filter(has_word)
    lines = lines.select("k1", "k2", "host", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(words_of(F.col("raw"))).alias("w"))
    removed = lines.join(frequent, ["host", "line"]).groupBy("k1", "k2").agg(F.sum("w").alias("removed"), F.collect_set("pos").alias("places"), F.count_if(F.col("pos") >= 0).alias("hits"))

    base = keyed.select(
        "doc_id", "k1", "k2", "text", F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_with_words(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words_of(F.col("text"))).cast("long").alias("n_repeat_words"),
    )
    # Rows that agree in id, host and text were summed together: hits / places of them.
    share = F.coalesce((F.col("removed") * F.size("places") / F.col("hits")).cast("long"), F.lit(0).cast("long"))
    out = base.join(removed, ["k1", "k2"], "left").withColumn("n_removed_words", share)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1), F.coalesce("places", F.array().cast("array<int>")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_kept * F.col("n_words"))).alias("kept"),
        let(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")).alias("clean_text"),
    )
