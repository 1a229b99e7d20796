"""Removing lines that equal an earlier line up to a few edits, by a segment-partition join.

A line is looked at without the white space around it, if it then has at least ``min_chars``
characters; shorter ones stay. It goes if an earlier line (by doc_id, then place) is at an edit
distance of at most ``edits``. Lines are judged on the input, not on what is left.

Equal lines are collapsed to their first place, by two hashes of 64 bits. The first ones are split into ``edits + 1`` segments: two
lines within ``edits`` share a segment, at a place that the difference of their lengths limits.
So every line is indexed by (length, segment number, segment) and looked up by its substrings at
the places allowed for each shorter length. Where more than ``crowd`` lines meet, the segment is
taken out and the rest is split in the same way, until few meet or little is left. Lines that meet
have a signature of 64 bits, of which an edit flips four at most: pairs that are further apart are not
made, so that lines with much in common, but not close, do not become candidates. Candidates are
verified, after common ends are cut off, with the banded bit-parallel edit distance: the band of the
matrix, ``2 * edits + 1`` wide, is one machine word that is moved along the diagonal.

Everything is a DataFrame or SQL function.

Cases: null texts stay null, empty ones empty. A null doc_id is the earliest. Rows with equal
doc_id are versions of one document: a place that is kept is kept in each. No rows give no
rows. All columns are kept; the counts replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import stored
from tidemill.session import stage

EDITS = 2
MIN_CHARS = 20
CROWD = 64
#: Places in a text stay below this.
PLACES = 10 ** 9

LEAST_ID = -(1 << 63)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\v\f"))


#: Up to so many line ids are broadcast to fetch their texts, and so many removed places to take them out; more are
#: joined by shuffling.
BROADCAST_ROWS = 500_000


def small_or_not(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, marked for broadcasting if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def with_firsts(docs: DataFrame, min_chars: int) -> DataFrame:
    """Columns doc, key_id, firsts, stored: ``firsts`` has the places (and line ids) at which a long line is the first."""
    key_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    lines = (docs.select(key_id.alias("key_id"), F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
             .select("key_id", "pos", bare(F.col("raw")).alias("line")).filter(F.char_length("line") >= min_chars))
    place = (F.col("key_id").cast("decimal(20,0)") * F.lit(PLACES) + F.col("pos")).cast("decimal(38,0)")
    firsts = (lines.groupBy(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))
              .agg(F.min(place).alias("first")))
    at = F.pmod(F.col("first"), F.lit(PLACES).cast("decimal(38,0)"))
    by_doc = (firsts.select(((F.col("first") - at) / F.lit(PLACES)).cast("long").alias("key_id"),
                            F.struct(at.cast("int").alias("at"), "id").alias("f"))
              .groupBy("key_id").agg(F.collect_list("f").alias("firsts")))  # bounded by the document
    held = docs.select(F.struct("*").alias("doc"), key_id.alias("key_id"))
    return stored(held.join(by_doc, "key_id", "left"), "first-lines", "zstd")


def first_lines(marked: DataFrame) -> DataFrame:
    """Columns id, line, n, key_id, at: every first line."""
    parts = F.struct(split_lines(F.col("doc.text")).alias("lines"), F.col("firsts").alias("firsts"))
    found = F.transform(F.array(parts), lambda s: F.transform(s["firsts"], lambda f: F.struct(
        f["id"].alias("id"), f["at"].alias("at"), bare(F.get(s["lines"], f["at"])).alias("line"))))[0]
    # versions of a document may have another line at the place
    return (marked.filter("firsts is not null").select("key_id", F.explode(found).alias("f")).select("key_id", "f.*")
            .filter(F.xxhash64("line") == F.col("id")).withColumn("n", F.char_length("line")))


def signature(text: Column) -> Column:
    """64 bits: which places hold an odd number of the pairs of neighbouring characters.

    An edit takes away two pairs and brings two at most, so it flips four bits at most.
    """
    def places(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.xxhash64(c, F.coalesce(F.get(chars, i + 1), F.lit(""))).bitwiseAND(
            F.lit(63)).cast("int"))

    bits = F.transform(F.array(F.split(text, "")), places)[0]
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, at: acc.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), at)))


def segment(length: Column, k: int, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``k``; the last ones take what does not divide."""
    base, longer = F.floor(length / k).cast("int"), length % k
    start = base * i + F.greatest(F.lit(0), i - (F.lit(k) - longer))
    return start, base + F.when(i >= F.lit(k) - longer, 1).otherwise(0)


def kind_of(edits: int, delta: int, i: int, shift: int, probe: bool) -> int:
    """Number of an entry for segment ``i``, moved by ``shift``, of a line shorter by ``delta``."""
    return ((delta * (edits + 1) + i) * (2 * edits + 1) + shift + edits) * 2 + probe


def unpacked(rows: DataFrame, edits: int) -> DataFrame:
    """``rows`` with probe, delta, i, start and size from kind and the line's length n."""
    width, k = 2 * edits + 1, edits + 1
    rest = F.floor(F.col("kind") / 2).cast("int")
    at = F.floor(rest / width).cast("int")
    found = rows.withColumns({"probe": is_probe(), "shift": rest % width - edits, "i": at % k,
                              "delta": F.floor(at / k).cast("int")})
    start, size = segment(F.col("n") - F.col("delta"), k, F.col("i"))
    return found.withColumns({"start": start + F.col("shift"), "size": size}).drop("shift")


def is_probe() -> Column:
    return F.col("kind") % 2 == 1


def indexed(edits: int) -> list[int]:
    """Kinds of a line's index entries. They also look up lines of the same length at the same place."""
    return [kind_of(edits, 0, i, 0, False) for i in range(edits + 1)]


def probes(edits: int, delta: int, same_place: bool) -> list[int]:
    """Kinds of a line's look-ups for lines shorter by ``delta``, at all places the difference allows."""
    out = []
    for i in range(edits + 1):
        for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
            if same_place or delta or shift:
                out.append(kind_of(edits, delta, i, shift, True))
    return out


def exploded(lines: DataFrame, parent: Column, kinds: list[int], edits: int) -> DataFrame:
    """``lines`` with key and kind: a row per kind whose segments are not empty, so that they lie within the line."""
    width, k = 2 * edits + 1, edits + 1
    # literals, so that little is worked out per row: one generic entry is compiled, a long list of them is not
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(kind // 2 % width - edits).alias("shift"),
                              F.lit(kind // 2 // width % k).alias("i"), F.lit(kind // 2 // width // k).alias("delta"))
                     for kind in kinds])
    rows = lines.withColumn("parent", parent).withColumn("e", F.explode(made)).filter(F.col("n") - F.col("e.delta") > edits)
    length = F.col("n") - F.col("e.delta")
    start, size = segment(length, k, F.col("e.i"))
    cut = F.substring(F.col("text"), start + F.col("e.shift") + 1, size)
    return rows.withColumns({"key": F.xxhash64("parent", length, "e.i", cut), "kind": F.col("e.kind")}).drop("e", "parent")


def met(rows: DataFrame) -> DataFrame:
    """Entries in buckets with an index entry and another one."""
    over = Window.partitionBy("key")
    return (rows.withColumn("met", F.count("*").over(over))
            .withColumn("indexed", F.sum(F.when(is_probe(), 0).otherwise(1)).over(over))
            .filter("met > 1 and indexed > 0").drop("indexed"))


def met_lines(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns id, line, n, first, sig of the lines with an entry in ``rows``, stored."""
    wanted = stage(rows.select("id").distinct(), "wanted")
    return stage(first_lines(marked).join(small_or_not(wanted), "id").select(
        "id", "line", "n", F.struct("key_id", "at").alias("first"), signature(F.col("line")).alias("sig")), "met-lines")


def candidates(marked: DataFrame, edits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids of lines that share a segment and may be close, each once, stored; and those lines."""
    root, parent = F.lit(0).cast("long"), F.col("parent")
    kinds = indexed(edits) + [p for d in range(edits + 1) for p in probes(edits, d, False)]
    texts = first_lines(marked).select("id", "n", F.col("line").alias("text"))
    rows = stage(met(exploded(texts, root, kinds, edits).drop("text", "n")), "segments")
    lines = met_lines(marked, rows)
    signed = lines.select("id", "sig")
    rows = rows.join(small_or_not(signed), "id")
    pairs = paired(rows.filter(F.col("met") <= crowd), edits)
    crowded = rows.filter(F.col("met") > crowd)
    if crowded.limit(1).count():
        # their texts are looked up once; what is left of them goes on with the entries
        wanted = stage(crowded.select("id").distinct(), "wanted")
        whole = lines.select("id", "n", F.col("line").alias("text")).join(small_or_not(wanted), "id")
        crowded = crowded.join(whole, "id")
    while crowded.limit(1).count():
        rest = stage(unpacked(crowded, edits).select(
            "id", "sig", F.col("key").alias("parent"), "kind", "probe", "delta",
            (F.col("n") - F.col("size")).alias("n"),
            F.concat(F.expr("left(text, start)"), F.expr("substring(text, start + size + 1)")).alias("text")), "rests")
        short = F.col("n") - F.col("delta") < 2 * (edits + 1)
        pairs = pairs.unionByName(paired(rest.filter(short).withColumn("key", parent), edits))
        rest = rest.filter(~short)
        held = ["id", "sig", "n", "text", "parent"]
        rows = exploded(rest.filter("not probe").select(held), parent, indexed(edits) + probes(edits, 0, False), edits)
        for d in range(edits + 1):
            rows = rows.unionByName(exploded(rest.filter(F.col("probe") & (F.col("delta") == d)).select(held), parent,
                                             probes(edits, d, True), edits))
        rows = stage(met(rows), "segments")
        pairs = pairs.unionByName(paired(rows.filter(F.col("met") <= crowd), edits))
        crowded = rows.filter(F.col("met") > crowd)
    return stage(pairs.distinct(), "line-pairs"), lines


def paired(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs of a bucket's lines, but those whose signatures are further apart than ``edits`` can bring them."""
    index = rows.filter(~is_probe()).select("key", F.col("id").alias("i"), F.col("sig").alias("i_sig"))
    look = rows.select("key", "id", "sig", is_probe().alias("probe"))
    may_link = F.bit_count(F.col("sig").bitwiseXOR(F.col("i_sig"))) <= 4 * edits
    return index.join(look, "key").filter(F.expr("i != id and (probe or i < id)") & may_link).select(
        F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b"))


def common_end(a: Column, b: Column, most: Column, part) -> Column:
    """Characters that two strings share at one end, at most ``most``; ``part(x, done, step)`` cuts from that end."""
    steps = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda done, step: F.when(
        (done + step <= most) & (part(a, done, step) == part(b, done, step)), done + step).otherwise(done))


def without_common_ends(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a_line, b_line, a_n, b_n) with middle parts a_mid, b_mid."""
    cut = lambda x, start, size: F.substring(x, start, size)
    headed = pairs.withColumn("head", common_end(
        F.col("a_line"), F.col("b_line"), F.least("a_n", "b_n"), lambda x, done, step: cut(x, done + 1, step)))
    most = F.least("a_n", "b_n") - F.col("head")
    tail = common_end(F.reverse("a_line"), F.reverse("b_line"), most, lambda x, done, step: cut(x, done + 1, step))
    tailed = headed.withColumn("tail", tail)
    middle = lambda s: cut(F.col(f"{s}_line"), F.col("head") + 1, F.col(f"{s}_n") - F.col("head") - F.col("tail"))
    return tailed.withColumns({"a_mid": middle("a"), "b_mid": middle("b")})


def maybe_within(shorter: Column, longer: Column, edits: int) -> Column:
    """False only for arrays of characters that are further apart: an edit brings or takes away one kind at most.

    Both ends of the middles differ, so a middle of several characters takes two edits.
    """
    ends = (F.size(longer) <= 1) if edits == 1 else F.lit(True)
    return ends & (F.size(F.array_except(shorter, longer)) <= edits) & (F.size(F.array_except(longer, shorter)) <= edits)


def within(shorter: Column, longer: Column, edits: int) -> Column:
    """Whether two lines are within ``edits``; arguments are arrays of characters, at most ``edits`` apart in length.

    Bit ``k`` of the band stands for row ``j - edits + k`` of column ``j``. ``vp`` and ``vn`` are the places
    where the matrix grows or falls by one going down, in terms of the next column's band. The
    distance is followed along the band's lower edge, then along the last row.
    """
    if not 0 < edits < 31:
        raise ValueError("edits has to be from 1 to 30")
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    m, length = F.size(longer), F.size(shorter)
    one = lambda x: F.lit(x).cast("long")
    start = F.struct(one(mask & ~((1 << edits) - 1)).alias("vp"), one(0).alias("vn"),
                     F.least(F.lit(edits), m).cast("int").alias("score"))

    def step(acc: Column, j: Column) -> Column:
        """Column ``j`` (from 1) against the rows of the longer line."""
        equal = one(0)
        for k in range(width):
            row = j - edits + k
            same = (row >= 1) & (row <= m) & (F.get(longer, row - 1) == F.get(shorter, j - 1))
            equal = equal + F.when(same, one(1 << k)).otherwise(one(0))
        with_equal = F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score"),
                              equal.alias("eq"))
        return F.transform(F.array(with_equal), lambda s: diagonal(s, j))[0]

    def diagonal(s: Column, j: Column) -> Column:
        eq, vp, vn = s["eq"], s["vp"], s["vn"]
        d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(one(mask))
        with_d0 = F.struct(vp.alias("vp"), vn.alias("vn"), s["score"].alias("score"), d0.alias("d0"))
        return F.transform(F.array(with_d0), lambda t: shift(t, j))[0]

    def shift(t: Column, j: Column) -> Column:
        vp, vn, d0 = t["vp"], t["vn"], t["d0"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(one(mask))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        # row m stands at this bit once the band has passed it
        at = (m - j + edits).cast("int")
        on_edge = t["score"] + F.when(d0.bitwiseAND(one(top)) == 0, 1).otherwise(0)
        bit = F.call_function("shiftleft", one(1), at)
        on_row = (t["score"] + F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0)
                  - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0))
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(one(mask)).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            F.when(j + edits <= m, on_edge).otherwise(on_row).cast("int").alias("score"))

    columns = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    score = F.aggregate(columns, start, step, lambda acc: acc["score"])
    return F.when(length > 0, score).otherwise(m) <= edits


def repeated(marked: DataFrame, edits: int, crowd: int) -> DataFrame:
    """Columns key_id, at: first places of the lines that are within ``edits`` of an earlier one."""
    pairs, lines = candidates(marked, edits, crowd)
    for side in ("a", "b"):
        pairs = pairs.join(lines.select(F.col("id").alias(side), F.col("line").alias(f"{side}_line"),
                                        F.col("n").alias(f"{side}_n"), F.col("first").alias(f"{side}_first")), side)
    cut = without_common_ends(pairs.filter(F.abs(F.col("a_n") - F.col("b_n")) <= edits))
    a_short = F.col("a_n") <= F.col("b_n")
    # stored, or the expressions of the middles would be worked out anew at every step of the band
    middles = stage(cut.select(
        F.when(a_short, F.col("a_mid")).otherwise(F.col("b_mid")).alias("shorter"),
        F.when(a_short, F.col("b_mid")).otherwise(F.col("a_mid")).alias("longer"),
        F.greatest("a_first", "b_first").alias("first")).filter(F.char_length("longer") > 0), "middles")
    chars = middles.select(*[F.filter(F.split(c, ""), lambda x: x != "").alias(c) for c in ("shorter", "longer")], "first")
    close = stage(chars.filter(maybe_within(F.col("shorter"), F.col("longer"), edits)), "close-middles")
    return close.filter(within(F.col("shorter"), F.col("longer"), edits)).select("first.*").distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; n_lines counts the long lines, n_removed those gone."""
    marked = with_firsts(docs, min_chars)
    gone = stage(repeated(marked, edits, crowd).groupBy("key_id").agg(F.collect_list("at").alias("gone")), "gone")
    none = F.array().cast("array<int>")

    def rebuilt(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s["lines"]) - 1)
        short = F.filter(places, lambda p: F.char_length(bare(F.get(s["lines"], p))) < min_chars)
        kept = F.array_intersect(F.array_except(F.transform(s["firsts"], lambda f: f["at"]), s["gone"]), places)
        stay = F.array_sort(F.array_union(kept, short))
        return F.struct(
            F.array_join(F.transform(stay, lambda p: F.get(s["lines"], p)), "\n").alias("text"),
            (F.size(places) - F.size(short)).cast("long").alias("n_lines"),
            (F.size(places) - F.size(stay)).cast("long").alias("n_removed"))

    # bound once as a lambda's variable, so a text is split once
    parts = F.struct(split_lines(F.coalesce(F.col("doc.text"), F.lit(""))).alias("lines"),
                     F.coalesce("firsts", F.array().cast("array<struct<at:int,id:bigint>>")).alias("firsts"),
                     F.coalesce("gone", none).alias("gone"))
    made = marked.join(small_or_not(gone), "key_id", "left").select(
        "doc", F.transform(F.array(parts), rebuilt)[0].alias("made"))
    columns = [F.when(F.col("doc.text").isNotNull(), F.col("made.text")).alias("text") if name == "text"
               else F.col(f"doc.`{name}`").alias(name)
               for name in docs.columns if name not in ("n_lines", "n_removed")]
    return made.select(*columns, "made.n_lines", "made.n_removed")
