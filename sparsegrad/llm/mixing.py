"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget. Complete epochs come first; the rest of the
budget is filled by a weighted sample without replacement: every document
draws the exponential key ``-ln(u) / weight``, documents are taken in key
order, and the sizes are prefix-summed up to the first that does not fit. The
gap before that document is filled from the documents behind it: of each size
class (powers of two) the one with the least key, large classes first, if it
fits. If the document at the edge would come closer to the budget than that,
it is taken instead.

The prefix sum is never one sorted group. Keys are cut into bins; the sizes
are summed by (source, bin) before any shuffle, the bin in which the budget
ends is cut again, and what is left there is summed by key and input partition
before single rows are ordered. What remains for each source is one cut-off
and at most a few dozen fillers, so deciding a document is a comparison, and a
source with a third of all rows, or one document repeated as often, costs no
more than others.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; size-0 documents are never worth taking in part; rows equal in
id and text share one draw but are taken one by one, in the order of a stored
row number; an empty table gives an empty result; extra columns do not matter
to ``plan`` and are carried by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_symbols, small, stored, unit_draw, words_of

SEED = 20240607
BINS = 4096
MAX_EPOCHS = 3
#: Weights of the sources in code point order, repeated.
CYCLE = (1, 2, 3)


def size_of(text: Column) -> Column:
    """Words of the text; null: 0."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight in [0.1, 1]: falls with the share of symbols among the
    characters."""
    t = F.coalesce(text, F.lit(""))
    marks = n_symbols(t) / F.greatest(F.lit(1), F.length(t))
    return F.lit(1.0) - F.lit(0.9) * F.least(F.lit(1.0), F.lit(4.0) * marks)


def source_key(source: Column) -> Column:
    """A join key that is never null; orders like the source, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~"))


def draw_key(doc_id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """The exponential key: -ln(u) / weight, least keys first."""
    return -F.log(unit_draw(F.lit(seed), doc_id, text)) / weight


def drawn(docs: DataFrame) -> DataFrame:
    """Narrow view: uid, doc_id, skey, size, key."""
    weight = quality_weight(F.col("text"))
    return docs.select("uid", "doc_id", source_key(F.col("source")).alias("skey"), size_of(F.col("text")).alias("size"),
                       draw_key(F.col("doc_id"), F.col("text"), weight).alias("key"))


def ranked(sources: DataFrame) -> DataFrame:
    """0-based rank by key over the whole table without one global window:
    ranks inside sorted ranges plus the counts of the ranges before."""
    ordered = stored(sources.repartitionByRange("skey").withColumn("_part", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("_part").orderBy("skey")
    # one row for each shuffle range, whatever the number of sources
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return (ordered.join(F.broadcast(starts), "_part")
            .withColumn("rank", F.row_number().over(inside) - 1 + F.col("_from")).drop("_part", "_from"))


def targets(rows: DataFrame) -> DataFrame:
    """skey, source_size, target for each source. Budgets are shared by
    weight, stop at ``MAX_EPOCHS`` times the source's size, and the excess is
    shared again among the rest until none is above; each round reads three
    sums, not rows."""
    sources = ranked(rows.groupBy("skey").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.col("rank") % len(CYCLE) + 1).cast("int"))
    sources = stored(sources.select("skey", "source_size", weight.alias("weight")), "source-weights")
    cap = F.lit(float(MAX_EPOCHS)) * F.col("source_size")
    total, level = float(sources.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        rest, open_weight = total - (got[0] or 0.0), got[1] or 0.0
        higher = rest / open_weight if open_weight else level
        if higher <= level or not open_weight:
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _digits(level: int) -> Column:
    """Where a row lies at one level of the descent to the budget's end; each
    level orders the rows of one digit of the level before."""
    # key / (1 + key) is monotone, and even enough for keys from 0 to hundreds
    spread = F.col("key") / (F.lit(1.0) + F.col("key"))
    if level < 2:
        return F.struct(F.floor(spread * float(BINS ** (level + 1))).alias("bin"))
    if level == 2:
        return F.struct(F.col("key"), F.shiftright("uid", 33).alias("part"))
    return F.struct(F.col("uid"))


def _edges(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """skey, rest, done, key, uid, size: the first document of a source, in the
    order of (key, uid), that does not fit into ``rest`` any more, and the words
    taken before it. Sources without such a document have no row."""
    edge = sources.filter("rest > 0").select("skey", "rest", F.lit(0).cast("long").alias("done"))
    live = rows.filter("size > 0").join(small(edge, n), "skey")
    for level in range(4):
        cell = live.withColumn("cell", _digits(level))
        sums = cell.groupBy("skey", "cell").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"),
                                                F.first("done").alias("done"))
        run = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        edge = (sums.withColumn("before", F.col("done") + F.coalesce(F.sum("s").over(run), F.lit(0)))
                .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))))
        edge = stored(edge.select("skey", "rest", F.col("before").alias("done"), "cell"), f"edge{level}")
        live = stored(cell.drop("rest", "done").join(small(edge, n), ["skey", "cell"]).drop("cell"), f"in-edge{level}")
    return live.select("skey", "rest", "done", "key", "uid", "size")


def _taken_before(key: str, uid: str) -> Column:
    return (F.col("key") < F.col(key)) | ((F.col("key") == F.col(key)) & (F.col("uid") < F.col(uid)))


def _fillers(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """skey, fill: the uids taken from behind the edge. One candidate a size
    class is found by a partial aggregate; the choice folds over at most 63."""
    gap = F.col("rest") - F.col("done")
    edge = edges.select("skey", gap.alias("gap"), F.col("key").alias("k"), F.col("uid").alias("u"), F.col("size").alias("edge_size"))
    behind = rows.join(small(edge, n), "skey").filter(
        (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~_taken_before("k", "u") & (F.col("uid") != F.col("u")))
    band = F.length(F.bin("size"))
    first = behind.groupBy("skey", band.alias("band")).agg(F.min(F.struct("key", "uid", "size")).alias("x"))
    bands = first.groupBy("skey").agg(F.reverse(F.sort_array(F.collect_list(F.struct("band", "x")))).alias("bands"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("fill"))

    def step(acc: Column, row: Column) -> Column:
        fits = row["x"]["size"] <= acc["gap"]
        return F.struct((acc["gap"] - F.when(fits, row["x"]["size"]).otherwise(0)).alias("gap"),
                        F.when(fits, F.concat(acc["fill"], F.array(row["x"]["uid"]))).otherwise(acc["fill"]).alias("fill"))

    none = F.array().cast(bands.schema["bands"].dataType)
    folded = edge.join(bands, "skey", "left").select(
        "skey", "gap", "u", "edge_size", F.aggregate(F.coalesce("bands", none), start, step).alias("r"))
    over = F.col("edge_size") - F.col("gap")
    return folded.select("skey", F.when(over < F.col("r.gap"), F.array("u")).otherwise(F.col("r.fill")).alias("fill"))


def cutoffs(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, int]:
    """For each source: epochs, and what the fractional epoch takes: the rows
    before (cut_key, cut_uid) and those in ``fill``."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = sources.withColumn("epochs", F.least(epochs, F.lit(MAX_EPOCHS)).cast("long"))
    state = stored(state.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "epochs")
    n = state.count()
    edges = _edges(rows, state, n)
    cut = edges.select("skey", F.col("key").alias("cut_key"), F.col("uid").alias("cut_uid"))
    fill = stored(_fillers(rows, edges, n), "fill")
    return stored(state.join(small(cut, n), "skey", "left").join(small(fill, n), "skey", "left").select(
        "skey", "source_size", "target", "epochs", "cut_key", "cut_uid", "fill"), "cuts"), n


def _copies() -> Column:
    part = _taken_before("cut_key", "cut_uid") | F.array_contains("fill", F.col("uid"))
    return (F.col("epochs") + F.coalesce(part, F.lit(False)).cast("long")).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every document."""
    rows = stored(drawn(docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("uid"))), "draws")
    cuts, n = cutoffs(rows, targets(rows))
    return rows.join(small(cuts, n), "skey").select(
        "doc_id", "size", "source_size", "target",
        (_copies() * F.col("size")).alias("taken"), _copies().alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every document's row as often as it is taken, with the
    columns of ``docs``. The documents are written once with their row numbers
    and not shuffled."""
    kept = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "mix-input")
    view = kept.select("uid", "row.doc_id", "row.text", "row.source")
    rows = stored(drawn(view), "draws")
    cuts, n = cutoffs(rows, targets(rows))
    weight = quality_weight(F.col("row.text"))
    keyed = kept.select("row", "uid", source_key(F.col("row.source")).alias("skey"),
                        draw_key(F.col("row.doc_id"), F.col("row.text"), weight).alias("key"))
    copies = keyed.join(small(cuts, n), "skey").select("row", _copies().cast("int").alias("copies"))
    return copies.filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
