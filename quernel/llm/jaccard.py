"""N-gram Jaccard join by grouped prefixes, and the classes of linked documents.

Documents with one and the same shingle set are one class. A class's shingles stand in a global order, common ones last;
two sets whose similarity reaches the threshold share a shingle of their prefixes. Classes with one prefix and size are
one group. Only groups meet over prefix shingles; a pair stays if the shared prefix shingles and what may follow could
reach the needed intersection; then members are expanded and verified on their whole sets, read from the texts.

Near copies would meet in all pairs, so groups first meet the most central group of each shingle's list only, the verified
links are drawn together into components, and afterwards just pairs across components meet: those of one component need no
further link. Nothing is lost, as in the end every pair across components that could be linked has been verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .shingles import shingle_sets, slices

#: Share of all shingles at which one counts as common, which bounds their number, and the bound of the list sent out.
COMMON, MOST_COMMON = 1e-6, 400_000
#: Buckets of ids that are sent out before texts are joined with the ids that need them.
BUCKETS = 1 << 20


def digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common enough to come last, sorted, and their counts. A shingle that makes up more than the share COMMON of
    all does so in some block of the input, so each block reports its own; the list has a bounded length. It only sets the
    order in which shingles are compared: any list gives the same result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            values, least = np.concatenate(held), max(2, int(COMMON * size))
            held.clear()
            values.sort()
            often = np.unique(values[least:][values[least:] == values[:-least]])  # what stands there more than `least` times
            counts = np.searchsorted(values, often, "right") - np.searchsorted(values, often)
            return pa.RecordBatch.from_arrays([pa.array(often), pa.array(counts)], names=["tok", "n"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                for s in shingle_sets(texts.slice(a, b - a).to_pylist(), words):
                    held.append(s)
                    size += len(s)
                if size > 3_000_000:
                    yield told()
                    size = 0
        if held:
            yield told()

    found = docs.select("text").mapInArrow(tidy(count), "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "tok").limit(MOST_COMMON).toArrow()
    tok, n = top.column("tok").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(tok)
    return tok[order], n[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, share: int) -> DataFrame:
    """doc_id, text_hash, n, cid (of the set), gid (of prefix and size), prefix, and the order's place of its last shingle (lc, lh)
    of the rows (doc_id, text, text_hash)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, often = sent.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                rows = []
                for s in shingle_sets(texts.slice(a, b - a).to_pylist(), words):
                    n = len(s)
                    if not n:
                        rows.append((0, None, None, None, None, None))
                        continue
                    at = np.minimum(np.searchsorted(tok, s), max(0, len(tok) - 1))
                    count = np.where(tok[at] == s, often[at], 0) if len(tok) else np.zeros(n, np.int64)
                    size = n - -(-share * n // 100) + 1
                    order = np.argsort(count, kind="stable")[:size]  # s is sorted, so ties stand in the order of hashes
                    head = s[order]
                    rows.append((n, digest(s), digest(np.concatenate([head, [n]])), head, int(count[order[-1]]), int(head[-1])))
                n, cid, gid, head, lc, lh = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(gid, pa.int64()), pa.array(head, pa.list_(pa.int64())), pa.array(lc, pa.int64()), pa.array(lh, pa.int64())], names=["doc_id", "text_hash", "n", "cid", "gid", "prefix", "lc", "lh"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, n bigint, cid bigint, gid bigint, prefix array<bigint>, lc bigint, lh bigint")


def verified(pairs: DataFrame, docs: DataFrame, repeated: DataFrame | None, scratch: Scratch, words: int, share: int) -> DataFrame:
    """The linked ones of the pairs (a, b, a_doc, b_doc) of class ids and documents that hold their sets. repeated: ids of more
    than one row."""
    need = pairs.select(F.col("a_doc").alias("doc_id")).union(pairs.select(F.col("b_doc").alias("doc_id")))
    # Buckets of the needed ids are BUCKETS rows at most, whatever the input, so they may be broadcast: most texts that are not
    # needed stay where they are, and the exact joins deal out the rest.
    bucket = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    marks = scratch.keep(need.select(bucket()).distinct())
    texts = docs.select("doc_id", "text", "text_hash", bucket()).join(F.broadcast(marks), "bucket", "left_semi").drop("bucket")
    if repeated is not None:  # one row for each text of an id, so that repeated rows don't multiply
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(texts.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    side = lambda s: texts.select(F.col("doc_id").alias(f"{s}_doc"), F.col("text").alias(f"{s}_text"))
    both = pairs.join(side("a"), "a_doc").join(side("b"), "b_doc").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                a, b, s, t = (c.to_pylist() for c in batch.slice(at, 128).columns)
                spans = slices(s + t)
                sets = [x for lo, hi in spans for x in shingle_sets((s + t)[lo:hi], words)]
                good = []
                for i, (x, y) in enumerate(zip(sets[: len(s)], sets[len(s) :], strict=True)):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    # Rows that share an id may hold other sets than the one asked for.
                    good.append(100 * inter >= share * (len(x) + len(y) - inter) and digest(x) == a[i] and digest(y) == b[i])
                yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(a, good, strict=True) if g], pa.int64()), pa.array([v for v, g in zip(b, good, strict=True) if g], pa.int64())], names=["a", "b"])

    out = scratch.keep(both.mapInArrow(tidy(run), "a bigint, b bigint").distinct())
    scratch.free(marks)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """v, c: the smallest id of each linked node's component, by minima over neighbours and pointer jumping."""
    both = scratch.keep(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    labels = scratch.keep(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        hop = scratch.keep(labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c")))
        new = scratch.keep(hop.alias("x").join(hop.select(F.col("v").alias("w"), F.col("c").alias("far")), F.col("c") == F.col("w"), "left").select("v", "was", F.least("c", F.coalesce("far", "c")).alias("c")))
        changed = new.where("c <> was").limit(1).count()
        scratch.free(hop, labels)
        labels = scratch.at(new._quernel_path, new.select("v", "c"))
        if not changed:
            scratch.free(both)
            return labels


def enough(c: str, share: int) -> F.Column:
    """Whether two sets with c shared prefix shingles may be similar enough: what may follow the prefix that ends first is
    bounded by its rest and by the smaller set. Columns a_n, a_p, a_lc, a_lh and b_ likewise."""
    first = (F.col("a_lc") < F.col("b_lc")) | ((F.col("a_lc") == F.col("b_lc")) & (F.col("a_lh") <= F.col("b_lh")))
    most = F.least(F.col(c) + F.when(first, F.col("a_n") - F.col("a_p")).otherwise(F.col("b_n") - F.col("b_p")), "a_n", "b_n")
    return ((100 + share) * most >= share * (F.col("a_n") + F.col("b_n"))) & (100 * F.least("a_n", "b_n") >= share * F.greatest("a_n", "b_n"))


def link(docs: DataFrame, scratch: Scratch, words: int = 5, share: int = 80, text: str = "text", stars: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, component (the smallest class id of it) and text_hash of every row.

    Null and empty texts have no shingles and are linked with nothing; rows with a null id are linked with nothing and get a
    null component_id; both have no component. Repeated rows are of one class, rows that share an id and differ in text of a
    class each. Texts are whole, however long. Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = scratch.keep(prefixes(docs, common_shingles(docs, words), words, share))
    live = signed.where("n > 0 and doc_id is not null")
    repeated = scratch.keep(live.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    repeated = repeated if repeated.limit(1).count() else None
    # Classes and groups: partly aggregated minima, so a hot class is one row for each task.
    classes = scratch.keep(live.groupBy("cid", "n", "gid").agg(F.min("doc_id").alias("doc")))
    groups = classes.groupBy("gid", "n").agg(F.min(F.struct("doc", "cid")).alias("lead"), F.count("*").alias("members")).select("gid", F.col("lead.doc").alias("doc"), F.col("lead.cid").alias("cid"), "members")
    lead = scratch.keep(live.join(groups.select(F.col("doc").alias("doc_id"), "cid", "members"), ["doc_id", "cid"]).dropDuplicates(["cid"]).select("gid", "doc_id", "cid", "n", F.size("prefix").cast("bigint").alias("p"), "lc", "lh", "members", "prefix"))
    facts = scratch.keep(lead.drop("prefix"))
    # A pair's first shared shingle lies in the prefix of either set and, in the smaller one, even within the shorter prefix
    # that a partner at least as large needs.
    short = F.col("n") - F.ceil(2.0 * share * F.col("n") / (100 + share)) + 1
    postings = lead.select("gid", short.alias("short"), F.posexplode("prefix").alias("pos", "tok")).select("gid", "tok", (F.col("pos") < F.col("short")).alias("early"))
    # Tables with one row for a shingle or a component are written before rows meet them, here and below: both sides of such a
    # join are plain exchanges then, and Spark can split the rows of a frequent shingle or a large component.
    shared = scratch.keep(postings.groupBy("tok").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo < hi").select("tok"))
    post = scratch.keep(postings.join(shared, "tok", "left_semi"))
    scratch.free(shared)
    # How central a group is: the share of its prefix that other groups hold too.
    central = scratch.keep(post.groupBy("gid").agg(F.count("*").alias("k")).join(facts.select("gid", "p"), "gid").select("gid", (F.col("k") / F.col("p")).alias("central")))
    side = lambda x: [F.col("gid").alias(f"{x}_gid"), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "p", "lc", "lh")), F.col("cid").alias(x), F.col("doc_id").alias(f"{x}_doc")]
    # Inside a group, members meet their leader.
    inner = classes.where("cid is not null").join(facts.where("members > 1").select("gid", F.col("cid").alias("b"), F.col("doc_id").alias("b_doc")), "gid").where("cid <> b").select(F.col("cid").alias("a"), "b", F.col("doc").alias("a_doc"), "b_doc")
    edges = None
    labels = None
    for turn in range(stars):
        # A group meets the most central group of each of its shingles' lists that is not of its component, and of those
        # it meets by this way the one that shares the most shingles.
        rank = F.struct(F.col("central") if turn == 0 else F.col("central") * (F.pmod(F.xxhash64("gid", F.lit(turn)), F.lit(1000)) + 1), "gid")
        hubs = scratch.keep(post.join(central, "gid").groupBy("tok").agg(F.max(rank)["gid"].alias("hub")))
        met = post.join(hubs, "tok").where("gid <> hub").groupBy("gid", "hub").agg(F.count("*").alias("c"))
        met = met.join(facts.select(*side("a")), F.col("gid") == F.col("a_gid")).join(facts.select(*side("b")), F.col("hub") == F.col("b_gid"))
        if labels is not None:
            met = met.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        best = met.where(enough("c", share)).groupBy("a").agg(F.max(F.struct("c", "b", "a_doc", "b_doc")).alias("x")).select("a", "x.b", "x.a_doc", "x.b_doc")
        pairs = scratch.keep(best.unionByName(inner) if turn == 0 else best)
        scratch.free(hubs)
        found = verified(pairs, docs, repeated, scratch, words, share)
        scratch.free(pairs)
        if edges is not None:
            found, old = scratch.keep(edges.union(found)), (edges, found, labels)
            scratch.free(*old)
        edges = found
        labels = components(edges, scratch)
    # Pairs across components: lists first meet as components, then their members. A group of several members has a list of
    # its own, which every one of them passes on to verification.
    own = facts.where("members > 1").select("gid", F.xxhash64("gid", F.lit("own")).alias("tok"), F.lit(True).alias("early"))
    lists = post.unionByName(own)
    each = lists.join(classes.select("gid", "cid", "n", "doc"), "gid").join(labels.select(F.col("v").alias("cid"), "c"), "cid", "left").withColumn("comp", F.coalesce("c", "cid")).drop("c")
    each = scratch.keep(each.select("tok", "comp", "cid", "n", "doc", "early"))
    scratch.free(post, central)
    kinds = each.groupBy("tok", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k"), F.max("early").alias("any"))
    kinds = scratch.keep(kinds)
    several = scratch.keep(kinds.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok"))
    every, kinds = kinds, scratch.keep(kinds.join(several, "tok"))
    scratch.free(every, several)
    # The component with fewer members in a list is expanded first, so a single document meets a large component once.
    x = kinds.select("tok", *(F.col(c).alias(f"x_{c}") for c in ("comp", "least", "most", "k", "any")))
    y = kinds.select("tok", *(F.col(c).alias(f"y_{c}") for c in ("comp", "least", "most", "k", "any")))
    fit = (100 * F.col("y_most") >= share * F.col("x_least")) & (100 * F.col("x_most") >= share * F.col("y_least")) & (F.col("x_any") | F.col("y_any"))
    cross = x.join(y, "tok").where((F.struct("x_k", "x_comp") < F.struct("y_k", "y_comp")) & fit).select("tok", F.col("x_comp").alias("ca"), F.col("y_comp").alias("cb"))
    one = lambda s, comp: each.select("tok", F.col("comp").alias(comp), *(F.col(c).alias(f"{s}_{c}") for c in ("cid", "n", "doc", "early")))
    near = 100 * F.least("a_n", "b_n") >= share * F.greatest("a_n", "b_n")
    early = F.when(F.col("a_n") == F.col("b_n"), F.col("a_early") & F.col("b_early")).when(F.col("a_n") < F.col("b_n"), F.col("a_early")).otherwise(F.col("b_early"))
    met = cross.join(one("a", "ca"), ["tok", "ca"]).join(one("b", "cb"), ["tok", "cb"]).where(near & early)
    met = met.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    # Whole prefixes of the pair tell how many shingles they share.
    heads = classes.select("cid", "gid", "doc").join(lead.select("gid", "p", "n", "lc", "lh", "prefix"), "gid")
    with_head = lambda s: heads.select(F.col("cid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("doc", "p", "n", "lc", "lh", "prefix")))
    met = met.join(with_head("a"), "a").join(with_head("b"), "b").withColumn("c", F.size(F.array_intersect("a_prefix", "b_prefix")))
    pairs = scratch.keep(met.where(enough("c", share)).select("a", "b", "a_doc", "b_doc"))
    scratch.free(each, kinds, lead, facts)
    found = verified(pairs, docs, repeated, scratch, words, share)
    scratch.free(pairs)
    edges, old = scratch.keep(edges.union(found)), (edges, found, labels)
    scratch.free(*old)
    labels = components(edges, scratch)
    scratch.free(edges)
    parts = scratch.keep(classes.join(labels.select(F.col("v").alias("cid"), "c"), "cid", "left").select("cid", F.coalesce("c", "cid").alias("comp"), "doc"))
    least = scratch.keep(parts.groupBy("comp").agg(F.min("doc").alias("component_id")))
    ids = scratch.keep(parts.join(least, "comp").select("cid", "comp", "component_id"))
    scratch.free(parts, least, classes, labels)
    named = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cid").join(ids, "cid", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return named.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"), F.when(linked, F.col("comp")).alias("component"), "text_hash")
