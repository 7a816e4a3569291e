"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import prefix_sums, saved, unused

#: 2^32 over the golden ratio: point i of the schedule is i times this, modulo 2^32.
GOLDEN = 2654435769
#: Words of a slot of the schedule.
BLOCK = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also src (rank by code point, null last), weight, target.

    Weights repeat over the ranks. `share` x all words is dealt by weight; a target stops at `most` x its source's
    size and the excess is dealt again by weight until none is above: sources sorted by cap per weight are capped
    as long as the level that the others would get reaches theirs. One row per source goes through one window.
    """
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    d = ranked.withColumns({"weight": w, "cap": F.lit(float(most)) * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    d = d.withColumn("level", left / rest)
    # the first source that its level does not fill sets the level of all after it
    level = F.first(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), F.col("cap")).otherwise(level * F.col("weight"))
    return d.select("source", "source_size", "src", "weight", target.alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, rank, slot): the slot of the mix that takes the rank-th block of a source.

    Slot i's point is the fractional part of (i + 1) / golden ratio, in 32-bit integers; cumulative weights cut
    [0, 1) into one interval per source. A source needs ceil(round(target) / block) slots. The points give each
    source that number up to a few; points beyond it are left out and missing ones follow at the end, so that
    counts are exact. Slots are rows of `range`, so they spread over all tasks; intervals join on 1,024 cells.
    """
    spark = targets.sparkSession
    t = targets.select("src", F.ceil(F.round("target") / block).cast("long").alias("need")).where("need > 0")
    total, sources = t.agg(F.sum("need"), F.max("src") + 1).first()
    total, sources = total or 0, sources or 1
    upto = F.sum("need").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    spans = t.withColumn("upto", upto).select("src", "need", ((F.col("upto") - F.col("need")) / F.lit(max(total, 1))).alias("low"),
                                              (F.col("upto") / F.lit(max(total, 1))).alias("high"))
    cell = lambda x: F.least(F.floor(x * 1024), F.lit(1023))
    cells = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = (F.col("slot") + 1) % F.lit(1 << 31) * F.lit(GOLDEN) % F.lit(1 << 32) / F.lit(float(1 << 32))
    points = spark.range(total).select(F.col("id").alias("slot")).withColumn("x", point).withColumn("cell", cell(F.col("x")))
    hits = points.join(cells, "cell").where("x >= low and x < high").select("src", "slot")
    place = F.lower(F.lpad(F.hex((F.col("slot") * F.lit(65536.0 / max(total, 1))).cast("long")), 4, "0"))
    ranked = prefix_sums(hits.withColumn("_place", place), ["src"], "_place", ["slot"], F.lit(1).cast("long"), "rank")
    drawn = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("drawn"))
    late = (t.join(drawn, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long"))).where("drawn < need")
            .select("src", F.explode(F.sequence("drawn", F.col("need") - 1)).alias("rank"))
            .select("src", "rank", (F.lit(total) + F.col("rank") * sources + F.col("src")).alias("slot")))
    kept = ranked.join(t, "src").where("rank < need").select("src", "rank", "slot")
    return kept.unionByName(late)


def mix(docs: DataFrame, doc_id: str, text: str, source: str, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
        most: float = 2.0, block: int = BLOCK, seed: str = "mix", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix all documents: (one row per document, one row per piece of the mix in slot order).

    Per document: _row, _id, _source and size (words), source_size, target (its source's), taken (words the mix takes,
    repeats counted). Pieces: slot, src, rank, _row, doc_id, first (word of the document), words.
    A source's documents, shuffled by MD5 of seed and id, form a stream of words that repeats; rank r of a source takes its
    words [r x block, (r + 1) x block), the last rank only up to round(target). As targets end at `most` times the
    source, no document is taken more often than that; what it takes of a document is whole copies and
    then its first words. `row` names a column that tells rows apart, else they are numbered. Null texts have no words; a null source is a source of its
    own, the last; null ids and repeated rows take part like others. No words at all: targets and taken are 0.
    """
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(
        F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""))).cast("long")
    light = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col(doc_id).alias("_id"),
                        F.col(source).alias("_source"), size.alias("size"))
    sizes = light.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumnRenamed("_source", "source")
    targets = saved(source_targets(sizes, weights, share, most))
    named = targets.select(F.col("source").alias("_name"), "src", "source_size", "target")
    light = light.join(named, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    light = light.withColumn("_digest", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    placed = saved(prefix_sums(light, ["src"], "_digest", ["_id", "size", "_row"], F.col("size"), "start").drop("_digest"))
    end = F.round("target").cast("long")
    laps = placed.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))))
    begin = F.col("lap") * F.col("source_size") + F.col("start")
    laps = laps.withColumns({"begin": begin, "stop": F.least(begin + F.col("size"), end)}).where("stop > begin")
    cut = laps.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))))
    low, high = F.greatest("begin", F.col("rank") * block), F.least("stop", (F.col("rank") + 1) * block)
    blocks = cut.select("src", "rank", "_row", F.col("_id").alias("doc_id"), (low - F.col("begin")).alias("first"),
                        (high - low).alias("words"))
    pieces = schedule(targets, block).join(blocks, ["src", "rank"]).select("slot", "src", "rank", "_row", "doc_id", "first", "words")
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    rows = placed.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return rows, pieces


def mixed_documents(docs: DataFrame, doc_id: str, text: str, source: str, n_chars: str | None = None, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row per whole copy taken, and one of the first words of a partly taken one.

    Documents of which the mix takes nothing have no row. `n_chars`, if given, is set anew for cut texts. The input is
    written once with a row number, since its texts meet their counts by it.
    """
    row, size, taken, copy = unused(docs, "row", "size", "taken", "copy")
    d = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    rows, _ = mix(d, doc_id, text, source, row=row, **options)
    counts = rows.where("taken > 0").select(F.col("_row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken))
    whole, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    out = d.join(counts.withColumn(copy, F.explode(F.sequence(F.lit(1), whole + (rest > 0).cast("int")))), row)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.col(copy) > whole
    now = F.when(cut, F.array_join(F.slice(words, F.lit(1), rest), " ")).otherwise(F.col(text))
    named = {text: now} | ({n_chars: F.when(cut, F.length(now)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return out.select(*[named[c].alias(c) if c in named else F.col(f"`{c}`") for c in docs.columns])
