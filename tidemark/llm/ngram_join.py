"""N-gram Jaccard join by vertical partitioning.

N-grams have one global order: those of few documents by hash, then the frequent ones. Documents with the same n-gram
set form a class, and only the class's smallest id goes on. Two sets of the wanted similarity share l of the first
n - ceil(t n) + l n-grams of either, so only those are posted, with l = n / 25
(for small n up to n / 4).

Candidates come in two rounds. First each document is paired with that one of its posting lists' smallest documents
with which it shares most lists; that links large groups with as many pairs as members. Then come all pairs of a
list whose ends are still in different components, if they share l lists: no link between components is lost, and
groups that the first round joined add none.

A candidate pair is verified by fragments: the global order is cut into FRAGMENTS ranges, each document's set with it,
and the overlap is counted in each fragment on its own and summed per pair. A pair whose first fragments leave no room
for the wanted overlap is dropped before the others are counted.

Frequent n-grams (by summed local counts, at most FREQUENT of them because their least count grows with the input) are
sent to all tasks. The documents that have one among their first n-grams and are still apart form families, which are
compared block by block of BLOCK documents as matrix products of their fragments.

Defined cases: null and empty texts have the empty set and are linked with nothing; fewer words than the width count as
one n-gram; equal sets are one class whatever their texts; rows that repeat an id with other texts are documents of
their own, and each row has the results of its text; a null id counts as the smallest and is null in the results; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import postings as P
from tidemark.llm import textkit as K
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import row_key
from tidemark.llm.shared import free_shuffles, lean, materialise, small_batches

WIDTH, PERCENT = 5, 80
FREQUENT = 1_000_000
FRAGMENTS, FIRST_FRAGMENTS = 8, 2
BLOCK = 256
_FLUSH = 3_000_000


def ngram_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z count as a-z."""
    starts, ends, word_offsets = K.words(data, offsets)
    hashes = K.Rolling(data, K.FOLDED).of(starts, ends)
    at, grams = K.windows(hashes, word_offsets, width)
    cuts = np.searchsorted(at, word_offsets)
    sets = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            sets.append(K.distinct(grams[a:b]))
        else:
            few = hashes[word_offsets[i] : word_offsets[i + 1]]
            total = np.zeros(min(1, len(few)), np.uint64)
            for k, h in enumerate(few):
                total = K.mix(total + h + np.uint64(k + 1))
            sets.append(total)
    return sets


def _least(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """ceil(percent n / 100)"""
    return -(-n * percent // 100)


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, first): of ids (null as the smallest number) with several texts the row key of one."""
    number, row = row_key(F.col(id_col), F.col(text_col))
    several = docs.select(number.alias("doc"), row.alias("row")).groupBy("doc").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    return materialise(several.filter("first <> last").select("doc", "first"), "ngram_versions")


def _rows(docs: DataFrame, versions: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, doc, text) and more: doc is the id of the input; id is that too, but for further texts of a doc their row key."""
    number, row = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(number.alias("doc"), row.alias("row"), F.col(text_col).alias("text"), *more).join(versions, "doc", "left")
    return keyed.withColumn("id", F.coalesce(F.when(F.col("row") != F.col("first"), F.col("row")), F.col("doc"))).drop("row", "first")


def frequent_ngrams(rows: DataFrame, width: int, most: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the n-grams of very many documents, at most `most` of them.

    Tasks report what they saw four times or more among _FLUSH n-grams, so a count is low by at most three per report;
    the order of n-grams may be any, so this costs speed, never results.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in K.slices(batches):
            held += (sets := ngram_sets(*K.utf8(batch.column("text")), width))
            n += sum(map(len, sets))
            if n >= _FLUSH:
                yield report(held, n)
                held, n = [], 0
        if n:
            yield report(held, n)

    def report(held: list[np.ndarray], n: int) -> pa.RecordBatch:
        grams, counts = K.counted(np.concatenate(held))
        often = counts >= 4
        grams, counts = grams[often].view(np.int64), counts[often].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([None, *grams], pa.int64()), pa.array([n, *counts], pa.int64())], names=["gram", "n"])

    counted = materialise(rows.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "frequent")
    total = counted.filter("gram is null").agg(F.sum("n")).first()[0] or 0
    # total / most is the least count, so no more than `most` n-grams can have it
    found = counted.filter(F.col("gram").isNotNull() & (F.col("n") >= max(64, -(-total // most)))).select("gram").toPandas()["gram"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


POSTING = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<u2")])
PLACED = np.dtype([*POSTING.descr, ("comp", "<i8")])


def least_common(n):
    """How many of the posted n-grams two similar sets share at least, if the smaller of this number is taken of both."""
    if isinstance(n, Column):
        return F.greatest(F.floor(n / 25), F.least(F.floor(n / 4), F.lit(16)), F.lit(1))
    return np.maximum(np.maximum(n // 25, np.minimum(n // 4, 16)), 1)


def needed(percent: int) -> P.Need:
    """Common lists that two documents need by their sizes, kept as 2048 log2(n) rounded down; 0 if the sizes differ too much."""
    most = int(2048 * np.log2(100 / percent)) + 3

    def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a["size"].astype(np.int64), b["size"].astype(np.int64)
        return np.where(np.abs(x - y) <= most, least_common(np.floor(2 ** (np.minimum(x, y) / 2048) + 1e-9).astype(np.int64)), 0)

    return need


def set_table(rows: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """id, doc, n, key_a, key_b (of the whole set), first (rare n-grams to post), often (frequent ones to post)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in K.slices(batches):
            sets = ngram_sets(*K.utf8(batch.column("text")), width)
            n = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([*sets, np.empty(0, np.uint64)])
            at = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
            often = known[at] == every if len(known) else np.zeros(len(every), bool)
            out = {"id": batch.column("id"), "doc": batch.column("doc"), "n": n, "key_a": [], "key_b": [], "first": [], "often": []}
            start = 0
            for s in sets:
                f = often[start : start + len(s)]
                start += len(s)
                wanted = len(s) - _least(len(s), percent) + int(least_common(len(s))) if len(s) else 0
                rare = s[~f][:wanted]
                out["first"].append(rare.view(np.int64))
                out["often"].append(s[f][: wanted - len(rare)].view(np.int64))
                out["key_a"].append(int(K.mix(s).sum(dtype=np.uint64).view(np.int64)))
                out["key_b"].append(int(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))

    return rows.mapInArrow(run, "id long, doc long, n long, key_a long, key_b long, first array<long>, often array<long>")


def _records(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("first")
    sizes = np.diff(lists.offsets.to_numpy())
    placed = "comp" in batch.schema.names
    out = np.empty(int(sizes.sum()), PLACED if placed else POSTING)
    out["key"] = lists.flatten().to_numpy().view(np.uint64)
    out["node"] = np.repeat(batch.column("id").to_numpy(), sizes)
    out["size"] = np.repeat((2048 * np.log2(np.maximum(batch.column("n").to_numpy(), 1))).astype(np.uint16), sizes)
    if placed:
        out["comp"] = np.repeat(batch.column("comp").to_numpy(), sizes)
    return out


def fragment_sets(rows: DataFrame, width: int) -> DataFrame:
    """id, fragment, grams: each set cut at fixed points of the global order of hashes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.arange(1, FRAGMENTS).astype(np.uint64) * np.uint64(2**64 // FRAGMENTS)
        for batch in K.slices(batches, most=1 << 20):
            ids, fragments, grams = [], [], []
            for i, s in zip(batch.column("id").to_pylist(), ngram_sets(*K.utf8(batch.column("text")), width), strict=True):
                ids += [i] * FRAGMENTS
                fragments += range(FRAGMENTS)
                grams += [x.view(np.int64) for x in np.split(s, np.searchsorted(s, cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fragments, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["id", "fragment", "grams"])

    return rows.mapInArrow(run, "id long, fragment int, grams array<long>")


def _fragments(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    return fragment_sets(P.probably_in(rows, ids, "id").join(ids, "id", "left_semi"), width).dropDuplicates(["id", "fragment"])


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    size_of = lambda c, n: sizes.select(F.col("id").alias(c), F.col("n").alias(n))
    return pairs.join(size_of("a", "na"), "a").join(size_of("b", "nb"), "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose summed overlap reaches the similarity."""

    def overlaps(some: DataFrame, which: Column) -> DataFrame:
        part = sets.filter(which)
        left = part.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = part.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("gb"))
        joined = some.join(left, "a").join(right, ["b", "fragment"])
        sums = [F.sum(F.size(F.array_intersect("ga", "gb"))).alias("common"), F.sum(F.size("ga")).alias("part_a"), F.sum(F.size("gb")).alias("part_b")]
        return joined.groupBy("a", "b", "na", "nb").agg(*sums)

    first = overlaps(pairs, F.col("fragment") < FIRST_FRAGMENTS)
    room = F.col("common") + F.least(F.col("na") - F.col("part_a"), F.col("nb") - F.col("part_b"))
    open_pairs = materialise(first.filter((100 + percent) * room >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb", F.col("common").alias("so_far")), "open_pairs")
    rest = overlaps(open_pairs.drop("so_far"), F.col("fragment") >= FIRST_FRAGMENTS)
    summed = rest.join(open_pairs.select("a", "b", "so_far"), ["a", "b"]).withColumn("total", F.col("common") + F.col("so_far"))
    return summed.filter((100 + percent) * F.col("total") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _family_links(rows: DataFrame, members: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between the members (id, n, comp, family) of one family that are in different components.

    A family is cut by size into classes and these into blocks of about `block` documents; a task gets two blocks whose
    sizes may match and counts all overlaps of their documents fragment by fragment as matrix products, so pairs are
    never rows.
    """
    step = float(np.log(100 / percent))
    sized = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("long"))
    counts = materialise(sized.groupBy("family", "class").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks")), "family_blocks")
    other = counts.select("family", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("with"), F.col("blocks").alias("with_blocks"))
    own = sized.join(counts, ["family", "class"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = own.join(other, ["family", "class"]).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("with_blocks") - 1)))
    here, there = F.struct(F.col("class").alias("c"), F.col("own").alias("b")), F.struct(F.col("with").alias("c"), F.col("theirs").alias("b"))
    met = met.select("id", "comp", "family", F.least(here, there).alias("x"), F.greatest(here, there).alias("y"), (here == F.least(here, there)).alias("left"))
    sets = materialise(_fragments(rows, members.select("id").distinct(), width).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("fragment", "grams"))).alias("parts")), "family_sets")

    @lean
    def run(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        is_left = np.array(table.column("left").to_pylist(), bool)
        sets = [[np.array(p["grams"], np.int64) for p in parts] for parts in table.column("parts").to_pylist()]
        left = np.flatnonzero(is_left)
        right = left if same else np.flatnonzero(~is_left)
        n = np.array([sum(map(len, s)) for s in sets])
        common = np.zeros((len(left), len(right)), np.float32)
        for f in range(FRAGMENTS):
            grams = K.distinct(np.concatenate([s[f] for s in sets]))
            seen = np.zeros((len(sets), len(grams)), np.float32)
            for i, s in enumerate(sets):
                seen[i, np.searchsorted(grams, s[f])] = 1
            common += seen[left] @ seen[right].T
        total = n[left][:, None] + n[right][None, :]
        good = ((100 + percent) * common.astype(np.int64) >= percent * total) & (comps[left][:, None] != comps[right][None, :])
        x, y = np.nonzero(good)
        a, b = ids[left[x]], ids[right[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.join(sets, "id").groupBy("family", "x", "y").applyInArrow(run, "a long, b long").distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_ngrams, class_id (smallest id with the same set), component_id."""
    found = _components(_rows(docs, _versions(docs, id_col, text_col), id_col, text_col), width, percent, buckets)
    shown = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return found.select(shown("doc").alias(id_col), F.col("n").alias("n_ngrams"), shown("class_doc").alias("class_id"), shown("component_doc").alias("component_id"))


def _components(rows: DataFrame, width: int, percent: int, buckets: int | None) -> DataFrame:
    """id, doc, n, class_doc, component_doc of rows (id, doc, text)."""
    spark = rows.sparkSession
    small_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_ngrams(rows, width))
    sets = materialise(set_table(rows, frequent, width, percent), "ngram_sets")
    classes = materialise(sets.filter("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("id").alias("class_id"), F.min("doc").alias("class_doc"), F.count(F.lit(1)).alias("members")), "ngram_classes")
    copies = sets.filter("n > 0").select("id", "key_a", "key_b", "n").join(classes.filter("members > 1"), ["key_a", "key_b", "n"]).filter("id <> class_id")
    copies = materialise(copies.select("id").distinct(), "ngram_copies")
    heads = P.without(sets.filter("n > 0").select("id", "n", "first", "often"), copies, "id")
    posted = sets.agg(F.sum(F.size("first"))).first()[0] or 0
    buckets = buckets or P.bucket_count(posted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    need = needed(percent)
    often = materialise(heads.filter("size(often) > 0").select("id", "n", "often"), "frequent_heads").select("id", "n", F.explode("often").alias("gram"))
    close = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    ids_of = lambda pairs: pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()

    # first round: every posting with its list's smallest document
    rare = P.candidate_pairs(P.posting_rows(heads.select("id", "n", "first"), _records, buckets), need, False, POSTING)
    leads = materialise(often.groupBy("gram").agg(F.min(F.struct("id", "n")).alias("lead")), "frequent_leads")
    with_lead = often.join(leads, "gram").withColumn("other", F.col("id") != F.col("lead.id")).filter(~F.col("other") | close(F.col("n"), F.col("lead.n")))
    lists, least = F.count(F.lit(1)).alias("lists"), F.min(least_common(F.least("n", "lead.n"))).alias("need")
    with_lead = with_lead.filter("other").groupBy(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).agg(lists, least)
    own = often.groupBy(F.col("id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("lists"), F.lit(0).cast("long").alias("need"))
    star = materialise(P.summed(rare.unionAll(with_lead).unionAll(own)), "star_pairs")
    free_shuffles(spark)
    # a document whose lists, shared with anyone at all, are fewer than it would have to share with one partner has none;
    # 79 % of the size: of a partner at the least similarity, with room for the rounding of posted sizes
    shared = star.filter("a = b").select(F.col("a").alias("id"), "lists")
    able = P.probably_in(sets.select("id", "n"), shared, "id").groupBy("id").agg(F.min("n").alias("n")).join(shared, "id")
    sizes = materialise(able.filter(F.col("lists") >= least_common(F.floor(F.col("n") * (percent - 1) / 100))).select("id", "n"), "met_sizes")
    met = sizes.select("id")
    # half of the lists are enough here: a group's members may share the others with another of them
    best = star.filter((F.col("a") != F.col("b")) & (F.col("lists") * 2 >= F.col("need"))).groupBy("b").agg(F.max(F.struct("lists", F.bitwise_not("a").alias("a"))).alias("best"))
    star = materialise(_sized(best.select(F.bitwise_not("best.a").alias("a"), "b"), sizes), "star_sized")
    ids = materialise(ids_of(star), "star_ids")
    fragments = materialise(_fragments(rows, ids, width), "star_fragments")
    links = materialise(verified(star, fragments, percent), "star_links")
    free_shuffles(spark)

    # second round: what is left between components, by the number of common lists, which is complete here
    labels = materialise(components(links), "star_components")
    placed = P.probably_in(heads, met, "id").join(met, "id", "left_semi").join(labels, F.col("id") == F.col("node"), "left").select("id", "n", "first", "often", F.coalesce("root", "id").alias("comp"))
    placed = materialise(placed, "placed")
    rare = P.candidate_pairs(P.posting_rows(placed.select("id", "n", "first", "comp"), _records, buckets), need, True, PLACED)
    some = placed.filter("size(often) > 0").select("id", "n", "comp", F.explode("often").alias("gram"))
    mixed = some.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("id").alias("lead")).filter("c0 < c1").select("gram", "lead")
    families = components(materialise(some.join(mixed, "gram").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "family_edges"))
    members = placed.select("id", "n", "comp").join(materialise(families, "families"), F.col("id") == F.col("node")).select("id", "n", "comp", F.col("root").alias("family"))
    family_links = materialise(_family_links(rows, materialise(members, "family_members"), width, percent), "family_links")
    cross = _sized(rare.filter("lists >= need").select("a", "b"), sizes)
    cross = materialise(cross.join(star.select("a", "b"), ["a", "b"], "left_anti"), "cross_pairs")
    free_shuffles(spark)
    more = materialise(ids_of(cross).join(ids, "id", "left_anti"), "cross_ids")
    fragments = fragments.unionAll(materialise(_fragments(rows, more, width), "cross_fragments"))
    links = links.unionAll(materialise(verified(cross, fragments, percent), "cross_links")).unionAll(family_links)
    labels = materialise(components(links), "ngram_components")

    by_class = classes.join(labels, classes["class_id"] == labels["node"], "left").select("key_a", "key_b", "n", "class_id", "class_doc", "root")
    least = by_class.filter("root is not null").groupBy("root").agg(F.min("class_doc").alias("least"))
    by_class = by_class.join(least, "root", "left").select("key_a", "key_b", "n", "class_doc", F.coalesce("least", "class_doc").alias("component_doc"))
    out = sets.select("id", "doc", "n", "key_a", "key_b").join(by_class, ["key_a", "key_b", "n"], "left")
    return out.select("id", "doc", "n", F.coalesce("class_doc", "doc").alias("class_doc"), F.coalesce("component_doc", "doc").alias("component_doc"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The input's rows and columns with the smallest id of each component only (null is the smallest); rows that repeat that id stay if they are in the component."""
    versions = _versions(docs, id_col, text_col)
    found = _components(_rows(docs, versions, id_col, text_col), width, percent, None)
    gone = materialise(found.filter("component_doc <> doc").select("id").distinct(), "ngram_gone")
    whole = _rows(docs, versions, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("whole")).select("id", "whole")
    return whole.join(gone, "id", "left_anti").select("whole.*")
