"""Near duplicates by a chosen-path join on word shingles.

A text is the set of its five-word shingles; sets of equal content are one node. Each node has ``TOKENS`` min-hash
tokens. A run of the join starts with all nodes in one bucket and splits buckets recursively: a node goes on to the
sub-buckets of those of its tokens that a hash of run, path and token chooses, 1 / similarity of them on average, so
nodes that share tokens stay together and others part. Buckets of at most ``BUCKET`` nodes are compared by brute
force. Two sets of similarity 0.8 meet in one run with a probability that falls with its depth; ``RUNS`` runs of at
most ``DEPTH`` splits bring the chance to miss them below one in a hundred at full depth, and below one in ten
thousand where one split suffices. Buckets still larger after the last split are compared in blocks, so none is cut.

What looks similar by its tokens is linked (links inside a bucket only as far as they connect it), linked nodes form
groups, and inside each group the exact similarity of every pair of whole texts decides: groups, too, are compared in
blocks. Pairs are counted, never emitted: each node gets its number of links, and a spanning forest of the links
gives the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, bounded_batches, components, free_name, free_shuffles, giving_back, staged, texts_of

WORDS = 5
SIMILARITY = 0.8
TOKENS = 64
RUNS = 10
DEPTH = 3
BUCKET = 128
BLOCK = 512
LOOKS = 0.6
"""Share of equal tokens from which two nodes are linked for the exact comparison: four standard errors below 0.8."""
CACHED = 150_000
BROADCAST_ROWS = 1_000_000
"""Rows of two or six numbers that may be broadcast; more of them meet the texts in a shuffle."""

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
CHOSEN = U(int(2**64 / (SIMILARITY * TOKENS)))


class WordHashes(dict):
    """Words to 64-bit hashes, computed once per task."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Ascending different hashes of a text's shingles. Fewer words than five are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out = out * U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(out))


def signature(items: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set."""
    out = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(items), 4096):
        part = (items[at : at + 4096, None] * SEEDS) >> U(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def node_of(items: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())).view(np.int64)))


def counted_side(rows: DataFrame) -> DataFrame:
    """``rows`` with the hint to broadcast them, if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def described(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``node`` and ``sig`` of every row; a null text counts as empty."""

    def describe(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes) for t in texts_of(batch)]
            yield batch[["doc_id", "text_key"]].assign(node=[node_of(s) for s in sets], sig=[signature(s).tobytes() for s in sets])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text")).mapInPandas(giving_back(describe), "doc_id bigint, text_key bigint, node bigint, sig binary")


def next_paths(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each sub-bucket that the rows go on to."""
    named = mix(tokens.astype(np.uint64) * U(TOKENS) + np.arange(TOKENS, dtype=np.uint64))
    ahead = mix(named + mix(paths)[:, None])
    rows, places = np.nonzero(mix(ahead ^ U(0x5851F42D4C957F2D)) < CHOSEN)
    return rows, ahead[rows, places]


def tokens_of(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.uint32).reshape(-1, TOKENS)


def first_split(nodes: DataFrame) -> DataFrame:
    """``(path, node)`` of all runs after their first split; the bucket that holds all nodes isn't gathered for it."""

    def split(batches: Batches) -> Batches:
        for batch in batches:
            if not len(batch):
                continue
            tokens, ids = tokens_of(batch["sig"]), batch["node"].to_numpy()
            for run in range(RUNS):
                rows, paths = next_paths(np.full(len(ids), run + 1, dtype=np.uint64), tokens)
                yield pd.DataFrame({"path": paths.view(np.int64), "node": ids[rows]})

    return nodes.select("node", "sig").mapInPandas(giving_back(split), "path bigint, node bigint")


def split_again(rows: DataFrame) -> DataFrame:
    """``(path, node)`` below ``rows(path, node, sig)``."""

    def split(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                at, paths = next_paths(batch["path"].to_numpy().view(np.uint64), tokens_of(batch["sig"]))
                yield pd.DataFrame({"path": paths.view(np.int64), "node": batch["node"].to_numpy()[at]})

    return rows.select("path", "node", "sig").mapInPandas(giving_back(split), "path bigint, node bigint")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        for node in queue:
            fresh = np.flatnonzero(linked[node] & left)
            left[fresh] = False
            out += [(node, x) for x in fresh.tolist()]
            queue += fresh.tolist()
    return out


def grouped_runs(batches: Batches, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The whole groups of rows that come sorted by ``keys``; groups are bounded by whoever formed them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = (batch[keys] == batch[keys].shift()).all(axis=1).to_numpy()
        starts = np.flatnonzero(~same)
        if held and (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all():
            starts = starts[1:]
        if len(starts):
            yield pd.concat([*held, batch.iloc[: starts[0]]], ignore_index=True) if held else batch.iloc[: starts[0]]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield batch.iloc[a:b]
            held = [batch.iloc[starts[-1] :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def in_groups(rows: DataFrame, keys: list[str], work: Callable[[Iterator[pd.DataFrame]], Batches], schema: str) -> DataFrame:
    """Python work on whole groups, which are brought together by their keys and read as a stream."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(giving_back(lambda batches: work(g for g in grouped_runs(batches, keys) if len(g))), schema)


def cells(rows: DataFrame, key: str, count: str, block: int, place: str) -> DataFrame:
    """Rows with the blocks ``i <= j`` that they are compared in: one cell for a group of at most ``block`` rows."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(place), blocks).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_other", count)


def alike_in(groups: Iterator[pd.DataFrame]) -> Batches:
    """Links that connect what looks similar in each bucket."""
    out: list[tuple[int, int]] = []
    for group in groups:
        if len(group) < 2:
            continue
        ids, tokens = group["node"].to_numpy(), tokens_of(group["sig"])
        if len(group) == 2:
            if (tokens[0] == tokens[1]).mean() >= LOOKS and ids[0] != ids[1]:
                out.append((ids[0], ids[1]))
        else:
            same = np.zeros((len(ids), len(ids)), dtype=np.uint8)
            for k in range(TOKENS):
                same += tokens[:, k][:, None] == tokens[:, k]
            out += [(ids[a], ids[b]) for a, b in forest(same >= LOOKS * TOKENS)]
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


def candidate_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` that connect all nodes which some bucket shows to look similar."""
    found, paths = None, first_split(nodes)
    signatures = nodes.select("node", "sig")
    for depth in range(1, DEPTH + 1):
        paths = staged(paths)
        free_shuffles(nodes.sparkSession)
        sizes = staged(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        last = depth == DEPTH
        # most buckets have one node and end here; the tokens follow those that go on
        rows = paths.join(sizes, "path").join(signatures, "node").select("path", "node", "sig", "n")
        compared = in_groups(cells(rows if last else rows.where(F.col("n") <= BUCKET), "path", "n", BLOCK if last else BUCKET, "node"), ["path", "i", "j"], alike_in, "a bigint, b bigint")
        found = compared if found is None else found.union(compared)
        if not last:
            if not sizes.where(F.col("n") > BUCKET).head(1):
                break
            paths = split_again(rows.where(F.col("n") > BUCKET))
    return staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets have a Jaccard similarity of at least ``SIMILARITY``, exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both >= SIMILARITY * (sizes.sum() - both)
        return np.array([[False, hit], [hit, False]])
    items, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, place, counts = np.unique(items, return_inverse=True, return_counts=True)
    shared = counts[place] > 1
    _, place = np.unique(place[shared], return_inverse=True)
    owners, both = owners[shared], np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, owners = place[order], owners[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):  # some items at a time bound the dense matrix
        low, high = np.searchsorted(place, [at, at + 2048])
        held = np.zeros((len(sets), 2048), dtype=np.float32)
        held[owners[low:high], place[low:high] - at] = 1
        both += held @ held.T
    hit = both >= SIMILARITY * (sizes[:, None] + sizes - both) - 1e-6
    np.fill_diagonal(hit, False)
    return hit & (sizes[:, None] > 0) & (sizes > 0)


def exact_in(groups: Iterator[pd.DataFrame]) -> Batches:
    """Of each cell: links per node, and the forest of links as rows with an ``other``."""
    hashes = WordHashes()
    for group in groups:
        ids, own, copies = group["node"].to_numpy(), group["_own"].to_numpy(), group["copies"].to_numpy()
        if len(ids) < 2:
            continue
        hit = similar([shingles(t, hashes) for t in texts_of(group)])
        edges = forest(hit)
        if group["i"].iloc[0] != group["j"].iloc[0]:  # pairs of one block are counted in that block's own cell
            hit = hit & (own[:, None] != own)
        texts, rows = hit.sum(axis=1), hit @ copies
        some = texts > 0
        yield pd.DataFrame({"node": ids[some], "other": pd.array([pd.NA] * int(some.sum()), dtype="Int64"), "texts": texts[some], "rows": rows[some]})
        yield pd.DataFrame({"node": [ids[a] for a, _ in edges], "other": pd.array([ids[b] for _, b in edges], dtype="Int64"), "texts": 0, "rows": 0})


def linked_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``class_id``, ``n_links``, ``n_texts`` and ``first`` for every row of ``documents``.

    Rows are linked if their texts' shingle sets have a similarity of 0.8 or more; a class is what links connect, and
    ``class_id`` its smallest doc_id. ``n_links`` counts the other rows that a row is linked to, copies included;
    ``n_texts`` the different other texts. Texts of equal sets are copies, as are texts without any word. ``first``
    marks the rows of the smallest doc_id (and, of those, smallest text hash) of their class; a null id comes first.
    """
    bounded_batches(documents.sparkSession)
    rows = staged(described(documents))
    nodes = staged(rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("head"), F.min("sig").alias("sig")))
    links = candidate_links(nodes)
    free_shuffles(documents.sparkSession)
    groups = components(links)
    free_shuffles(documents.sparkSession)
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = staged(groups.join(sizes, "root").join(nodes.select("node", "copies", "head"), "node"))
    # whole texts of the members alone, one per node
    heads = members.select("root", "n", "node", "copies", F.col("head.doc_id").alias("_id"), F.col("head.text_key").alias("_key"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = texts.join(counted_side(heads), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.select("root", "n", "node", "copies", "text").dropDuplicates(["root", "node"])
    exact = in_groups(cells(found, "root", "n", BLOCK, "node"), ["root", "i", "j"], exact_in, "node bigint, other bigint, texts bigint, rows bigint")
    exact = staged(exact)
    free_shuffles(documents.sparkSession)
    classes = components(exact.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = exact.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("linked"))
    of_node = nodes.join(classes, "node", "left").join(counts, "node", "left")
    of_node = staged(of_node.select("node", "copies", "head", F.coalesce("root", "node").alias("root"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("linked", F.lit(0)).alias("linked")))
    lead = staged(of_node.groupBy("root").agg(F.min("head").alias("lead")))
    of_node = staged(of_node.join(lead, "root"))
    out = rows.select("doc_id", "text_key", "node").join(of_node, "node")
    return out.select(
        "doc_id", "text_key", F.col("lead.doc_id").alias("class_id"), (F.col("linked") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_texts"),
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_key") == F.col("lead.text_key"))).alias("first"),
    )


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: its ``first``, and one of several equal ones. The columns stay as they are."""
    keys = staged(linked_documents(documents).groupBy("doc_id", "text_key").agg(F.max("first").alias("first"), F.count("*").alias("n")))
    here, text_hash = free_name(documents, "doc"), free_name(documents, "hash")
    rows = documents.withColumn(here, F.col("doc_id").cast("bigint")).withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit(""))))

    def same(side: DataFrame) -> Column:
        return rows[here].eqNullSafe(side["_id"]) & (rows[text_hash] == side["_key"])

    named = keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "first", "n")
    gone = counted_side(named.where(~F.col("first") | (F.col("n") > 1)).select("_id", "_key"))
    again = counted_side(named.where(F.col("first") & (F.col("n") > 1)).select("_id", "_key"))
    kept = rows.join(gone, same(gone), "left_anti")
    one_of = rows.join(again, same(again), "left_semi").dropDuplicates([here, text_hash])
    return kept.unionByName(one_of).select(*documents.columns)
