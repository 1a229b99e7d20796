"""Exact Jaccard join of documents on word shingles, by a size-aware heavy-light scheme.

Documents with the same shingles are collapsed into one *set*. Sets meet in buckets:

* a *heavy* set (more than ``x`` shingles) enters the inverted lists of the shingles in its prefix:
  of any two sets that link, the prefixes (all but the shingles that may be missing, and one)
  share a shingle;
* a *light* set (at most ``x``) enumerates all subsets of two shingles of its prefix, taken one
  shingle longer: sets that link share two there. Light sets that are large enough to link with a
  heavy one stand in the inverted lists, too;
* the boundary ``x`` is the one that costs least, counting a light set's subsets and the entries
  that a heavy one's lists make it look at.

Prefixes are in order of a hash. Sets with a very common shingle in their prefix (a passage that
many documents share) get a second one, in which the common shingles come last; only such sets
meet by it. Any order finds all links, this one keeps the buckets small.

Links are verified by counting shared shingles. So that a group of n near copies does not make n * n
pairs, every bucket is first compared with its most central members only, which then leave it, and
what already is connected is not compared again. Of the pairs that are left, if a bound on their
difference allows a link, the nearest between any two components come first; the others are compared
one by one if their components are still apart. No link that joins two components is lost.

Cases: words are cut at ASCII white space, A-Z in lower case. A text with fewer words than a shingle
is one shingle; one without words (or null) has none and links with nothing. Equal rows fall
together, a null doc_id is not the least of a component unless all are null. No rows give no rows.
Shingles are 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.graph import components
from tidemill.llm.quality import LOWER
from tidemill.llm.rows import run_hashes, scramble, slices, word_hashes
from tidemill.session import stage

#: The largest boundary that is considered between light and heavy sets.
LIGHT_MOST = 40
#: A shingle in more prefixes than this is common ...
COMMON = 64
#: ... and at most so many of the most common are put last.
COMMON_MOST = 1 << 18
#: Up to so many sets (three numbers each) are broadcast to fetch their texts; more are joined by shuffling.
BROADCAST_SETS = 200_000
#: Rounds in which each bucket is compared with one central member.
ROUNDS = 4
#: A pair is left to an earlier bucket if one of so many buckets before is the same in both sets.
BUCKETS_BEFORE = 3
#: Entries are written anew with their components when so large a part of the sets (one in ...) has found a link.
RELABEL_SHARE = 200


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    hashes = word_hashes(text.translate(LOWER).split())
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < words:  # never equal to a shingle of full length
        return scramble(run_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(run_hashes(hashes, words))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def fingerprint(shingles: np.ndarray) -> int:
    """64 bits for the whole set."""
    if not len(shingles):
        return 0
    mixed = scramble(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(scramble(total).view(np.int64)[0])


SETS = "doc_id long, id long, th long, n long, cid long, prefix array<long>, parity array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    """``id`` is the doc_id, or the least number for null; ``th`` a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def parity_words(n: int) -> int:
    """Words of 64 bits for the parity of a set: four to eight bits per shingle, a power of two."""
    return 16 << max(0, (n - 1) // 256).bit_length()


def parity(shingles: np.ndarray) -> np.ndarray:
    """Which places hold an odd number of shingles, a place being some bits of the hash."""
    m = 64 * parity_words(len(shingles))
    flips = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(flips.astype(np.uint8)).view("<i8")


def prefix_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document its set's size, fingerprint and the shingles of least hash, one more than a prefix."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sizes, cids, prefixes, parities = [], [], [], []
            for text in texts:
                s = shingle_set(text, words)
                n = len(s)
                sizes.append(n)
                cids.append(fingerprint(s))
                # sets that cannot link with a different set take no part
                none = n * 100 < percent * (n + 1)
                prefixes.append(s[:0 if none else n - least_overlap(n, percent) + 2].view(np.int64))
                parities.append(s[:0].view(np.int64) if none else parity(s))
            yield pa.record_batch([
                *batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                names=["doc_id", "id", "th", "n", "cid", "prefix", "parity"])

    return stage(keyed(docs).mapInArrow(measure, SETS), "shingle-sets")


def prefix_of_each(found: DataFrame) -> DataFrame:
    """Columns cid, n, prefix: a row per set."""
    return found.groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def light_boundary(found: DataFrame, percent: int) -> int:
    """Boundary between light and heavy sets with the least cost; 0 for no light sets."""
    small = prefix_of_each(found.filter((F.col("n") <= LIGHT_MOST) & (F.size("prefix") > 0)))
    lists = small.select("n", F.explode("prefix").alias("h"))
    seen = lists.groupBy("h").agg(F.count("*").alias("c"))
    looked = {r["n"]: r["cost"] for r in lists.join(seen, "h").groupBy("n").agg(
        F.sum("c").alias("cost")).collect()}  # one row per size up to LIGHT_MOST
    numbers = {r["n"]: r["sets"] for r in small.groupBy("n").agg(F.count("*").alias("sets")).collect()}

    def cost(x: int) -> int:
        subsets = 0
        for n, count in numbers.items():
            if n <= x:
                p = n - least_overlap(n, percent) + 2
                subsets += count * p * (p - 1) // 2
        return subsets + sum(c for n, c in looked.items() if n > x)

    return min(range(LIGHT_MOST + 1), key=cost)


def keys(prefix: Column, n: Column, x: int, percent: int) -> Column:
    """Bucket keys of a set: structs of key and whether it is a subset's.

    ``prefix`` has one shingle more than inverted lists need.
    """
    singles = F.transform(F.slice(prefix, 1, F.size(prefix) - 1), lambda h: F.struct(
        h.alias("key"), F.lit(False).alias("subset")))
    if not x:
        return singles
    places = F.sequence(F.lit(1), F.size(prefix))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(places, lambda j: j > i),
        lambda j: F.struct(F.xxhash64(F.element_at(prefix, i), F.element_at(prefix, j)).alias("key"),
                           F.lit(True).alias("subset")))))
    light = F.when(n * 100 > F.lit(percent * x), F.concat(singles, pairs)).otherwise(pairs)
    return F.when(n > x, singles).otherwise(light)


def buckets(sets: DataFrame, x: int, percent: int) -> DataFrame:
    """Entries (cid, n, key, subset, members) of buckets with more than one set."""
    entries = sets.filter(F.size("prefix") > 1).select(
        "cid", "n", F.explode(keys(F.col("prefix"), F.col("n"), x, percent)).alias("k")).select("cid", "n", "k.*")
    return (entries.withColumn("members", F.count("*").over(Window.partitionBy("key", "subset")))
            .filter("members > 1"))


def common_shingles(entries: DataFrame, common: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the most common shingles, bounded whatever the input, and the least log2 of their counts."""
    hot = entries.filter((F.col("members") > common) & ~F.col("subset")).groupBy("key").agg(
        F.max("members").alias("members"))
    by_power = hot.groupBy(power_of("members").alias("power")).agg(F.count("*").alias("n")).collect()
    power, left = 64, COMMON_MOST
    for r in sorted(by_power, key=lambda r: -r["power"]):  # one row per power of two
        if r["n"] > left:
            break
        power, left = r["power"], left - r["n"]
    chosen = hot.filter(power_of("members") >= power).select("key").toArrow()
    return np.sort(chosen.column("key").to_numpy()), power


def power_of(count: str) -> Column:
    return F.length(F.bin(count))  # exact, unlike a logarithm


def chosen_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns cid, text of the documents in ``wanted`` (id, th, cid); few are looked up by broadcasting them."""
    wanted = stage(wanted, "wanted")
    few = wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    return keyed(docs).join(F.broadcast(wanted) if few else wanted, ["id", "th"]).select("cid", "text")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``known``, sorted. ``np.isin`` would sort all of ``known`` anew for every text."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def moved_prefixes(texts: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """Columns cid, n, prefix of ``texts`` (cid, text), with the common shingles last."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            sizes, prefixes = [], []
            for text in raw:
                s = shingle_set(text, words).view(np.int64)
                last = among(s, common)
                sizes.append(len(s))
                prefixes.append(np.concatenate([s[~last], s[last]])[:len(s) - least_overlap(len(s), percent) + 2])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()),
                                   pa.array(prefixes, pa.list_(pa.int64()))], names=["cid", "n", "prefix"])

    return texts.mapInArrow(load, "cid long, n long, prefix array<long>")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """Columns cid, shingles of ``texts`` (cid, text), stored."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            arrays = [shingle_set(text, words).view(np.int64) for text in raw]
            yield pa.record_batch([batch.column(0), pa.array(arrays, pa.list_(pa.int64()))], names=["cid", "shingles"])

    return stage(texts.mapInArrow(load, "cid long, shingles array<long>"), "full-sets")


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def flipped(a: Column, b: Column) -> Column:
    """Bits in which two parities of equal size differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def folded(a: Column) -> Column:
    """Parity of the same set in half as many bits."""
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))


SHORT = [f"parity{i}" for i in range(4)]


def short_parity() -> list[Column]:
    """Parity of a set in 256 bits: the places of the longer ones, taken modulo 256."""
    steps = F.sequence(F.lit(0), (F.size("parity") / 4).cast("int") - 1)

    def word(i: int) -> Column:
        own = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get("parity", k * 4 + i)))
        return F.when(F.size("parity") > 0, own).otherwise(F.lit(0).cast("long"))

    return [word(i).alias(name) for i, name in enumerate(SHORT)]


def close_enough(a: Column, b: Column, n: Column, percent: int) -> Column:
    """Whether sets with these parities and ``n`` shingles together can link.

    Sets that link differ in at most (100 - percent) / (100 + percent) of their shingles together, and
    each shingle in only one of them flips one bit.
    """
    differ = (F.when(F.size(a) == F.size(b), flipped(a, b)).when(F.size(a) == 2 * F.size(b), flipped(folded(a), b))
              .when(2 * F.size(a) == F.size(b), flipped(a, folded(b))).otherwise(F.lit(0)))
    return differ * (100 + percent) <= n * (100 - percent)


def side(frame: DataFrame, name: str, *columns: str) -> DataFrame:
    return frame.select(F.col("cid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Columns a, b, n (shingles together): of the pairs (a, b) those that the parities in ``sets`` leave."""
    total = F.col("a_n") + F.col("b_n")
    return pairs.join(side(sets, "a", "n", "parity"), "a").join(side(sets, "b", "n", "parity"), "b").filter(
        close_enough(F.col("a_parity"), F.col("b_parity"), total, percent)).select("a", "b", total.alias("n"))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link, stored. Only sets that the parities leave are loaded whole."""
    near = stage(near_pairs(pairs, sets, percent), "near-pairs")
    if not near.limit(1).count():
        return near.select("a", "b")
    wanted = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    full = full_sets(chosen_texts(docs, sets.join(wanted, "cid", "left_semi").select("lead.*", "cid")), words)
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return stage(near.join(side(full, "a", "shingles"), "a").join(side(full, "b", "shingles"), "b").filter(
        shared * 100 >= (F.col("n") - shared) * percent).select("a", "b").distinct(), "verified")


BEFORE = [f"before{i}" for i in range(BUCKETS_BEFORE)]


def with_before(entries: DataFrame) -> DataFrame:
    """Entries (bucket, cid, ...) with the buckets of the same set that come before, in order of their hash."""
    order = Window.partitionBy("cid").orderBy("bucket")
    return entries.select("*", *[F.lag("bucket", i + 1).over(order).alias(c) for i, c in enumerate(BEFORE)])


def none_shared(a: list[str], b: list[str]) -> Column:
    """Whether two sets that meet in a bucket share none of the buckets just before it.

    Sets that share one meet there too, or still earlier; none is shared before the first of all, so each pair
    keeps that one.
    """
    same = F.lit(False)
    for x in a:
        for y in b:
            same = same | F.coalesce(F.col(x) == F.col(y), F.lit(False))
    return ~same


#: Weights are compared in steps of one to so many.
WEIGHT_STEPS = 1 << 24


def met_heads(work: DataFrame, rank: Column, percent: int) -> DataFrame:
    """Entries without their buckets' heads (of the largest rank), stored; ``head`` if the two may link.

    ``left`` tells whether an entry has others to meet in its bucket than the head, which has met all.
    """
    head = [F.max_by(c, rank).alias(f"head_{c}") for c in ("cid", "n", "comp")]
    heads = work.groupBy("bucket").agg(*head, F.count("*").alias("members"))
    may_link = (F.col("comp") != F.col("head_comp")) & sizes_allow(F.col("n"), F.col("head_n"), percent)
    met = work.join(heads, "bucket").filter(F.col("cid") != F.col("head_cid")).select(
        "cid", "n", "bucket", "comp", F.when(may_link, F.col("head_cid")).alias("head"),
        (F.col("members") > 2).alias("left"))
    return stage(met.filter(F.col("left") | F.col("head").isNotNull()), "met")


def link_components(entries: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int,
                    rounds: int = ROUNDS) -> DataFrame:
    """Columns node, comp over all links between sets that share a bucket."""
    links = None
    # the larger the share of its shingles that others have, too, the more central a set is among its near copies
    central = F.count("*").over(Window.partitionBy("cid")) / F.col("n")
    work = stage(entries.select("cid", "n", "bucket", central.alias("weight"), F.col("cid").alias("comp")), "entries")
    done, new, n_sets = None, 0, sets.count()
    for round_ in range(rounds):
        rank = F.xxhash64("cid", F.lit(round_))
        if not round_:
            steps = F.least(F.col("weight") * WEIGHT_STEPS, F.lit((1 << 31) - 1)).cast("long")
            rank = F.shiftleft(steps, 32).bitwiseOR(rank.bitwiseAND(F.lit((1 << 32) - 1)))
        met = met_heads(work, rank, percent)
        work = met.filter("left").select("cid", "n", "bucket", "comp")
        pairs = met.filter("head is not null").select(
            F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        if round_ and not pairs.limit(1).count():
            break
        found = verified(pairs, sets, docs, words, percent)
        links = found if links is None else links.unionByName(found)
        new += found.count()
        if new * RELABEL_SHARE >= n_sets:  # a few links more change hardly any label
            work, new = relabelled(work, links), 0
    # parities of four words here; the whole ones come to each pair once, when it is verified
    rest = with_before(work.select("bucket", "cid", "n", "comp")).join(sets.select("cid", *short_parity()), "cid")
    other = rest.select(*[F.col(c).alias(f"{c}_") for c in rest.columns])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in SHORT[1:]),
                 F.bit_count(F.col(SHORT[0]).bitwiseXOR(F.col(f"{SHORT[0]}_"))))
    total = F.col("n") + F.col("n_")
    pairs = rest.join(other, (F.col("bucket") == F.col("bucket_")) & (F.col("cid") < F.col("cid_"))
                      & (F.col("comp") != F.col("comp_")) & sizes_allow(F.col("n"), F.col("n_"), percent)
                      & none_shared(BEFORE, [f"{c}_" for c in BEFORE])
                      & (differ * (100 + percent) <= total * (100 - percent)))
    pairs = stage(pairs.select(F.col("cid").alias("a"), F.col("cid_").alias("b"), F.col("comp").alias("a_comp"),
                               F.col("comp_").alias("b_comp"), (differ / total).alias("apart")).distinct()
                  .join(done, ["a", "b"], "left_anti"), "pairs")
    # many of these pairs are of large sets, of whose parities a quarter is enough to tell most apart
    quarter = sets.select("cid", "n", folded(folded(F.col("parity"))).alias("parity"))

    def linked(some: DataFrame) -> DataFrame:
        return verified(near_pairs(some, quarter, percent).select("a", "b"), sets, docs, words, percent)

    nearest = stage(nearest_pairs(pairs), "nearest")
    first = linked(nearest.select("a", "b"))
    later = still_apart(pairs, nearest.join(first, ["a", "b"], "left_semi")).join(nearest, ["a", "b"], "left_anti")
    return components(links.unionByName(first).unionByName(linked(stage(later.select("a", "b"), "later"))))


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """Of the pairs between any two components the one that seems least apart."""
    ends = [F.least("a_comp", "b_comp").alias("x"), F.greatest("a_comp", "b_comp").alias("y")]
    least = pairs.groupBy(*ends).agg(F.min(F.struct("apart", "a", "b", "a_comp", "b_comp")).alias("pair"))
    return least.select("pair.a", "pair.b", "pair.a_comp", "pair.b_comp")


def still_apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Of the pairs (a, b, a_comp, b_comp) those whose components are not connected by the ``linked`` ones."""
    comps = components(linked.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    for end in ("a", "b"):
        now = comps.select(F.col("node").alias(f"{end}_comp"), F.col("comp").alias(f"{end}_now"))
        pairs = pairs.join(now, f"{end}_comp", "left")
    return pairs.filter(F.coalesce("a_now", "a_comp") != F.coalesce("b_now", "b_comp"))


def relabelled(work: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with their components so far; buckets that lie in one component go."""
    comps = components(links)
    now = work.drop("comp").join(comps, work["cid"] == comps["node"], "left").withColumn(
        "comp", F.coalesce("comp", "cid")).drop("node")
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(
        "lo != hi").select("bucket")
    return stage(now.join(several, "bucket", "left_semi"), "entries")


def shingle_components(docs: DataFrame, words: int = 4, percent: int = 85, common: int = COMMON,
                       boundary: int | None = None) -> DataFrame:
    """Columns doc_id, th, n_shingles, component_id, group: a row per input row.

    ``group`` numbers the components, null for documents without shingles; ``th`` is a hash of the text.

    ``boundary`` overrides the boundary between light and heavy sets.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent has to be above 50")
    found = prefix_sets(docs, words, percent)
    filled = found.filter("n > 0")
    # the prefixes are read where they lie: once, and not stored a second time
    sets = stage(filled.groupBy("cid").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("id", "th")).alias("lead"), F.first("n").alias("n"),
        F.first("parity").alias("parity")), "sets")
    x = light_boundary(filled, percent) if boundary is None else boundary
    first = stage(buckets(prefix_of_each(filled), x, percent), "buckets")
    frequent, power = common_shingles(first, common)
    entries = first.withColumn("bucket", F.xxhash64("key", "subset"))
    if len(frequent):
        is_common = ~F.col("subset") & (F.col("members") > common) & (power_of("members") >= power)
        hit = first.filter(is_common).select("cid").distinct()
        texts = chosen_texts(docs, sets.join(hit, "cid", "left_semi").select("lead.*", "cid"))
        moved = moved_prefixes(texts, frequent, words, percent)
        if filled.groupBy("id", "th").count().filter("count > 1").limit(1).count():  # equal rows
            moved = moved.dropDuplicates(["cid"])
        entries = entries.filter(~is_common).unionByName(buckets(moved, x, percent).withColumn(
            "bucket", F.xxhash64("key", "subset", F.lit("moved"))))
    comps = link_components(entries, sets, docs, words, percent)
    grouped = sets.select("cid", "least").join(comps, sets["cid"] == comps["node"], "left").withColumn(
        "comp", F.coalesce("comp", "cid")).drop("node")
    least = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_set = grouped.join(least, "comp").select(F.col("cid").alias("c"), "component_id", F.col("comp").alias("group"))
    return found.join(by_set, (F.col("cid") == F.col("c")) & (F.col("n") > 0), "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id (null first), then text hash.

    Documents without shingles all stay; of rows that are equal in doc_id and text one stays.
    """
    held = stage(shingle_components(docs, words, percent).select("doc_id", "th", "group"), "groups")
    leads = held.filter("group is not null").groupBy("group").agg(
        F.min(F.struct("doc_id", "th")).alias("lead")).select("lead.*").union(
        held.filter("group is null").select("doc_id", "th").distinct())
    leads = leads.select(F.col("doc_id").alias("lead_id"), F.col("th").alias("lead_th"))
    # in a struct, so that no column of the input clashes
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("key_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_th"))
    kept = rows.join(leads, F.col("key_id").eqNullSafe(F.col("lead_id")) & (F.col("key_th") == F.col("lead_th")),
                     "left_semi")
    repeated = held.filter("group is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        empty = (F.coalesce(F.length("doc.text"), F.lit(0)) == 0)
        kept = kept.filter(~empty).dropDuplicates(["key_id", "key_th"]).unionByName(kept.filter(empty))
    return kept.select("doc.*")
