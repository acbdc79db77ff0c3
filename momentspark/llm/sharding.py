"""Balanced label propagation (dealt operator 3): linked documents move to one shard under capacity quotas.

Law `rows`: any two shards differ by at most one document. Links join documents of equal text. Documents start spread over the
shards by hash. In each round the documents of a group that has not settled look at the shards of their neighbours, as these stand by then, and ask
together for the shard with most of them among those with room for all; a shard grants requests, larger groups first, as far as its
quota goes. Rounds go on while a group fits anywhere. A group larger than a shard moves in parts that fill shards. What fits no shard as a whole (fewer
groups than shards) is cut: into the largest room that is left, and what then fits into one shard into the one with the least room
for it. Documents without links fill the rest. Rows move by joins and sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _ranks(rows: DataFrame, keys: list[str], n_rows: int, scratch: Scratch) -> DataFrame:
    """Adds `rank` (long, from 0) among rows of one key, by `row`: in hash buckets of about 5,000 rows, each shifted by
    the counts of those before, so that no key meets in one task."""
    buckets = max(64, -(-n_rows // 5000))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = scratch.write(counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shift")
    inner = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("row")) - 1
    return dealt.withColumn("inner", inner).join(shift, [*keys, "bucket"]).withColumn("rank", (F.col("inner") + F.col("shift")).cast("long")).drop("bucket", "inner", "shift")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at or below the value."""
    out = F.lit(0)
    for b in bounds:
        out = out + (value >= F.lit(b)).cast("int")
    return out


def propagate(units: DataFrame, quota: list[int], scratch: Scratch, shared: list[bytes], most_rounds: int = 200, buckets: int = 4096) -> tuple[DataFrame, DataFrame, list[int]]:
    """(settled: text_key, part, label; waiting: units that fit no shard as a whole; what is left of `quota`).

    units: text_key, part, n, votes (map from shards to how many of its documents start there). `shared` are the keys that have several units: a
    settled one votes for its shard in the next round. Units of over half a shard ask first, then those of over an eighth, then all: small ones would
    take the room of large ones. Rounds end when no unit fits; where a round grants nothing, requests are dealt more finely.
    """
    shards, room, settled = len(quota), list(quota), None
    steps = [max(quota) // 2, max(quota) // 8, 0]
    every, waiting = units, units.where(F.col("n") > steps[0])
    for k in range(most_rounds):
        while steps and waiting.where(F.col("n") <= max(room)).isEmpty():
            least = steps.pop(0)
            if steps:
                more = every.where((F.col("n") <= least) & (F.col("n") > steps[0]))
                waiting = waiting.select(*units.columns).union(more.select(*units.columns))
        if not steps:
            break
        free = F.array(*[F.lit(int(q)) for q in room])
        votes = F.col("votes")
        if settled is not None and shared:
            placed = settled.where(F.col("text_key").isin(shared)).groupBy("text_key", "label").agg(F.sum("n").alias("n"))  # at most as many as shards
            placed = placed.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_neighbours"))
            waiting, votes = waiting.join(placed, "text_key", "left"), F.when(F.col("by_neighbours").isNotNull(), F.map_zip_with("votes", "by_neighbours", lambda s, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))).otherwise(F.col("votes"))
        asked = waiting.withColumn("room", free).withColumn("now", votes).withColumn("round", F.lit(k))
        wish = F.expr(f"array_max(transform(sequence(0, {shards} - 1), s -> if(room[s] >= n, struct(coalesce(now[s], 0) as v, pmod(xxhash64(round, text_key, part, s), 1000003) as h, s as s), null))).s")
        asked = asked.withColumn("label", wish).withColumn("size_class", F.floor(F.log2("n")).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("round", "text_key", "part"), F.lit(buckets)).cast("int"))
        asked = scratch.write(asked.select(*units.columns, "label", "size_class", "bucket"), "asked")
        in_turn = Window.partitionBy("label").orderBy(F.desc("size_class"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = asked.where("label is not null").groupBy("label", "size_class", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(in_turn))
        granted = scratch.write(sums.where(F.col("upto") <= F.element_at(free, F.col("label") + 1)), "granted")
        taken = {r[0]: r[1] for r in granted.groupBy("label").agg(F.sum("n")).collect()}
        if not taken:
            buckets, waiting = buckets * 8, asked.select(*units.columns)
            continue
        room = [q - taken.get(s, 0) for s, q in enumerate(room)]
        turn = ["label", "size_class", "bucket"]
        won = asked.join(granted.select(*turn), turn, "left_semi").select("text_key", "part", "n", "label")
        settled = won if settled is None else settled.union(won)
        lost = asked.join(granted.select(*turn), turn, "left_anti")  # those without a wish among them
        waiting = scratch.write(lost.select(*units.columns), "waiting")
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    if settled is None:
        settled = units.limit(0).select("text_key", "part", "n", F.lit(0).alias("label"))
    return scratch.write(settled.select("text_key", "part", "label"), "settled"), waiting, room


def _cut(waiting: DataFrame, goal: list[int], room: list[int]) -> tuple[list[tuple], list[int]]:
    """Of units that fit nowhere (fewer than shards): (text_key, part, cuts) with (first rank, shard, slot of that rank) of each piece, and what is left of `room`.

    Two ways, and of these the one with the fewest pieces of a unit, then in all: what fits one shard goes to the tightest and what does not into the
    largest room; or one unit after another along the rooms, largest first.
    """
    units = sorted(waiting.select("text_key", "part", "n").collect(), key=lambda u: (-u["n"], bytes(u["text_key"]), u["part"]))

    def allot(tight: bool) -> tuple[tuple, list, list[int]]:
        left, out = list(room), []
        order = sorted(range(len(room)), key=lambda s: (-room[s], s))
        for u in units:
            cuts, at = [], 0
            while at < u["n"]:
                rest = u["n"] - at
                if tight:
                    s = min((s for s, r in enumerate(left) if r >= rest), key=lambda s: (left[s], s), default=None)
                    s = max(range(len(left)), key=lambda s: (left[s], -s)) if s is None else s
                else:
                    s = next(s for s in order if left[s])
                cuts.append((at, s, goal[s] - left[s]))
                take = min(rest, left[s])
                at, left[s] = at + take, left[s] - take
            out.append((u["text_key"], u["part"], cuts))
        pieces = [len(c) for *_, c in out]
        return (max(pieces, default=0), sum(pieces)), out, left

    return min(allot(True), allot(False), key=lambda x: x[0])[1:]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size long, text_crc32 long, law string, shard int, slot long) for each row of `docs`.

    size: UTF-8 bytes of the text and 16. Null texts count as empty, and rows of equal text (empty ones too) are a group,
    whatever their ids; repeated rows keep their own place. Slots run from 0 in each shard without gaps. A group of more rows than a shard
    holds is cut into parts that fill a shard each, and a rest. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(slim, "rows")
    sizes = scratch.write(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n_rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    holds = n_rows // shards
    goal = [holds + (s < n_rows % shards) for s in range(shards)]

    # groups that no shard holds are fewer than shards; their rows get parts by rank
    large = {bytes(r["text_key"]): r["n"] for r in sizes.where(F.col("n") > max(goal)).where("n > 1").collect()} if holds else {}
    keyed = rows.withColumn("part", F.lit(0).cast("long"))
    if large:
        ranked = _ranks(rows.where(F.col("text_key").isin(list(large))), ["text_key"], n_rows, scratch)
        keyed = rows.where(~F.col("text_key").isin(list(large))).withColumn("part", F.lit(0).cast("long")).unionByName(ranked.withColumn("part", F.floor(F.col("rank") / holds).cast("long")).drop("rank"))
        keyed = scratch.write(keyed, "keyed")
    linked = sizes.where("n > 1").select("text_key", F.lit(True).alias("linked"))
    start = F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int")
    votes = keyed.join(linked, "text_key").groupBy("text_key", "part", start.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    units = scratch.write(votes.groupBy("text_key", "part").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("votes")), "units")  # at most `shards` votes each
    settled, waiting, room = propagate(units, goal, scratch, list(large))

    cut, left = _cut(waiting, goal, room)
    cuts = docs.sparkSession.createDataFrame(cut, "text_key binary, part long, cuts array<struct<first:long,shard:int,slot:long>>")
    kept = keyed.join(settled, ["text_key", "part"], "left").join(cuts, ["text_key", "part"], "left")
    unit = F.when(F.col("cuts").isNotNull(), F.concat("text_key", F.col("part").cast("string").cast("binary"))).otherwise(F.lit(b""))
    placed = kept.select("id", "size", "crc", "row", F.coalesce("label", F.lit(-1)).alias("label"), unit.alias("unit"), "cuts")
    ranked = _ranks(scratch.write(placed, "placed"), ["label", "unit"], n_rows, scratch)
    # of a cut unit the piece that begins last at or before the rank; documents without links fill the shards in order
    piece = F.element_at(F.filter("cuts", lambda c: c["first"] <= F.col("rank")), -1)
    ends = [0]
    for s in range(shards):
        ends.append(ends[-1] + left[s])
    free = _range_of(F.col("rank"), ends[1:shards])
    base = F.element_at(F.array(*[F.lit(g - r - e).cast("long") for g, r, e in zip(goal, left, ends, strict=False)]), free + 1)
    ranked = ranked.withColumn("piece", F.when(F.col("cuts").isNotNull(), piece))
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("piece.shard", free)).cast("int").alias("shard"),
        F.when(F.col("label") >= 0, F.col("rank")).otherwise(F.coalesce(F.col("piece.slot") + F.col("rank") - F.col("piece.first"), F.col("rank") + base)).cast("long").alias("slot"),
    )
