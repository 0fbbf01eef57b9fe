"""Mixing sources to target weights (2): pivotal dependent rounding in a reduction tree.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, n_words_of, narrow

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents, or residuals of the level below, that one fold pairs up.
BLOCK = 256
TINY = 1e-12


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_units, target) of (source, source_size, n_units): one row a source.

    target = min(max_repeats * source_size, level * weight), the level such that the targets add up to all sizes: that is
    where resharing the excess by weight ends.  The table has a row a source, which is a configuration, not a corpus;
    that is why its windows may be global.
    """
    k = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % k + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (F.lit(float(max_repeats)) * F.col("source_size")))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, above, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("v")))).over(whole)["v"])
    return s.select("source", "source_size", "n_units", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Pairs the items (h, size, p) of a block one after the other; {at, p, out: [{i, up}]}, ``at`` the residual's index or -1.

    Of a pair, either the first gains and the second loses words of expected mass, or the other way round, with chances that
    leave every expectation as it is, until one of the two is 0 or 1.  The words expected in total don't change.
    """
    done = "array<struct<i:int,up:int>>"
    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("p"), F.array().cast(done).alias("out"))

    def state(at: Column, p: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), p.cast("double").alias("p"), out.alias("out"))

    def decided(i: Column, up: Column) -> Column:
        return F.array(F.struct(i.cast("int").alias("i"), up.cast("int").alias("up")))

    def pair(acc: Column, j: Column) -> Column:
        a, b, p, q = F.get(items, acc["at"])["size"].cast("double"), F.get(items, j)["size"].cast("double"), acc["p"], F.get(items, j)["p"]
        u = (F.xxhash64(F.lit(seed), F.get(items, acc["at"])["h"], F.get(items, j)["h"], acc["p"]).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
        moves = F.struct((a * (1 - p)).alias("a_up"), (b * q).alias("b_down"), (a * p).alias("a_down"), (b * (1 - q)).alias("b_up"), a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"), u.alias("u"))

        def moved(m: Column) -> Column:
            gain, lose = F.least(m["a_up"], m["b_down"]), F.least(m["a_down"], m["b_up"])
            first_gains = m["u"] * (gain + lose) < lose
            new_p = F.when(first_gains, F.when(m["a_up"] <= m["b_down"], F.lit(1.0)).otherwise(m["p"] + m["b_down"] / m["a"])).otherwise(F.when(m["a_down"] <= m["b_up"], F.lit(0.0)).otherwise(m["p"] - m["b_up"] / m["a"]))
            new_q = F.when(first_gains, F.when(m["a_up"] <= m["b_down"], m["q"] - m["a_up"] / m["b"]).otherwise(F.lit(0.0))).otherwise(F.when(m["a_down"] <= m["b_up"], m["q"] + m["a_down"] / m["b"]).otherwise(F.lit(1.0)))
            return F.struct(_snap(new_p).alias("p"), _snap(new_q).alias("q"))

        def settle(r: Column) -> Column:
            open_p, open_q = (r["p"] > 0) & (r["p"] < 1), (r["q"] > 0) & (r["q"] < 1)
            return (
                F.when(open_p, state(acc["at"], r["p"], F.concat(acc["out"], decided(j, r["q"]))))
                .when(open_q, state(j, r["q"], F.concat(acc["out"], decided(acc["at"], r["p"]))))
                .otherwise(state(F.lit(-1), F.lit(0.0), F.concat(acc["out"], decided(acc["at"], r["p"]), decided(j, r["q"]))))
            )

        return let(let(moves, moved), settle)

    def step(acc: Column, j: Column) -> Column:
        return F.when(acc["at"] < 0, state(j, F.get(items, j)["p"], acc["out"])).otherwise(pair(acc, j))

    return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), start, step)


def _snap(p: Column) -> Column:
    return F.when(p < TINY, F.lit(0.0)).when(p > 1 - TINY, F.lit(1.0)).otherwise(p)


UNIT = ("doc_id", "source", "size", "source_size", "target", "n", "base")


def mixed_units(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: Sequence[int], max_repeats: int, seed: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, n, copies): rows equal in id, source and size are one unit of n rows."""
    units = durable(docs.groupBy(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).agg(F.count("*").alias("n")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units"))
    targets = durable(source_targets(sources, weights, max_repeats), "targets")
    expected = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.doc_id", "u.source", "u.size", "t.source_size", "t.target", "u.n", "t.n_units", expected.alias("e"))
    u = u.withColumn("base", F.floor(F.col("e") + TINY)).withColumn("p", _snap(F.greatest(F.col("e") - F.col("base"), F.lit(0.0))))
    u = u.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull(), "size")).withColumn("blocks", F.ceil(F.col("n_units") / BLOCK))
    coin = (F.xxhash64(F.lit(seed + 1), "h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) < F.col("p")

    open_unit = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    #: What isn't a fraction, and documents without words, which take none whatever is decided.
    done = [u.filter(~open_unit).select(*UNIT, F.when(F.col("p") >= 1, F.lit(1)).when(F.col("p") <= 0, F.lit(0)).otherwise(coin.cast("int")).alias("up"))]
    level = u.filter(open_unit).select(*UNIT, "h", "p", "blocks")
    most = targets.agg(F.max("n_units")).first()[0] or 0
    while True:
        item = F.struct("h", "doc_id", "source", "size", "source_size", "target", "n", "base", "p", "blocks")
        folded = (
            level.groupBy("source", F.pmod(F.xxhash64("h", "blocks"), F.col("blocks")).alias("block"))
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select("items", let(F.col("items"), lambda x: _fold(x, seed)).alias("r"))
        )
        folded = durable(folded, "fold")
        out = folded.select(F.explode(F.transform(F.col("r.out"), lambda o: F.struct(F.get(F.col("items"), o["i"]).alias("x"), o["up"].alias("up")))).alias("o"))
        done.append(out.select(*[F.col(f"o.x.{c}") for c in UNIT], F.col("o.up").alias("up")))
        rest = folded.filter("r.at >= 0").select(F.get("items", F.col("r.at")).alias("x"), F.col("r.p").alias("p"))
        level = rest.select(*[F.col(f"x.{c}") for c in UNIT], F.col("x.h"), "p", F.ceil(F.col("x.blocks") / BLOCK).alias("blocks"))
        most = -(-most // BLOCK)
        if most <= 1:
            break
    done.append(level.select(*UNIT, coin.cast("int").alias("up")))  # at most one a source
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", (F.col("base") + F.col("up")).cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per row of ``docs``.

    Each source gets words near its target (`source_targets`): off by no more than one document's size, as moving expected
    words between two documents of a source leaves their sum, and one residual a source is rounded at the end.  Level by level,
    blocks of about `BLOCK` items leave one residual each, which the next level pairs up; every level is written to the
    shared folder.  Choices come from hashes of ids: a rerun decides alike.

    A null text has size 0 and takes no words; null sources are one source, last in order; rows equal in id, source and
    size share the copies their sum gets as evenly as can be; an empty table gives an empty one; further columns are
    ignored.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    u = mixed_units(rows, "doc_id", "source", n_words_of(F.col("text")), weights, max_repeats, seed)
    each = u.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    copies = (F.expr("copies div n") + (F.col("k") < F.col("copies") % F.col("n")).cast("long")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; parameters and cases as of `mix`."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    names = docs.columns
    at = {c: f"__c{names.index(c)}" for c in (id_col, text_col, source_col)}
    rows = docs.toDF(*[f"__c{i}" for i in range(len(names))]).withColumn("__size", n_words_of(F.col(at[text_col])))
    u = mixed_units(narrow(docs, doc_id=id_col, text=text_col, source=source_col), "doc_id", "source", n_words_of(F.col("text")), options.get("weights", WEIGHTS), options.get("max_repeats", MAX_REPEATS), options.get("seed", 7))
    u = u.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__usize"), F.col("n").alias("__n"), F.col("copies").alias("__copies")).filter("__copies > 0")
    same = F.col(at[id_col]).eqNullSafe(F.col("__id")) & F.col(at[source_col]).eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__usize"))
    joined = rows.join(u, same)
    alone = joined.filter("__n = 1").withColumn("__mine", F.col("__copies"))
    w = Window.partitionBy(at[id_col], at[source_col], "__size").orderBy(at[text_col])
    shared = joined.filter("__n > 1").withColumn("__k", F.row_number().over(w) - 1)
    shared = shared.withColumn("__mine", F.expr("__copies div __n") + (F.col("__k") < F.col("__copies") % F.col("__n")).cast("long")).drop("__k")
    kept = alone.unionByName(shared).filter("__mine > 0").withColumn("__r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mine"))))
    return kept.select(*[F.col(f"__c{i}") for i in range(len(names))]).toDF(*names)
