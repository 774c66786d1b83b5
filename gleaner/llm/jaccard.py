"""Exact n-gram Jaccard self-join of documents with a token-group matrix.

A document's set holds its distinct word shingles as 64-bit hashes; equal sets are one node, so copies cost nothing more.

1. Similar nodes are partitioned into groups: nodes that share a min-hash are compared with one leader each, and go into
   the group of a leader that is near (others are groups of their own). Large groups are cut into chunks. The links
   that this finds give first components; their nodes need no further links to each other.
2. The matrix is addressed by prefixes: under an order of all shingles that puts the most frequent ones last, linked sets share
   l shingles among the first n - ceil(t * n) + l of each, l being about `SHARE` percent of the set. Shingles are dealt by
   their hash, and what nodes of different components share there is summed up by query and group: pairs with less than
   the lesser l are out.
3. Of each candidate, the group's whole shingle union bounds the overlap: fewer than t * n shingles of the query in
   it exclude all members. Only groups that qualify are opened, and their members compared exactly.

No link between sets of different components is lost, whatever the order of shingles: which of them count as
frequent (the `HOT_KEPT` most frequent, from counts over all documents) only decides how many candidates there are.
Nothing of a document is held by the driver. Shingles are told apart by 64-bit hashes, as are nodes.

Null or empty text: an empty set, linked with nothing. Fewer words than a shingle has: the whole sequence is the
set's one element. Repeated rows are copies. Very long texts are compared whole. Null doc_id: the document takes part, its component_id is the
least doc_id of its component, null if there is none. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD, hashes, mixed, new_folder, removed, slices, table, tasks, texts_of, word_codes, written
from .components import components

SHINGLE, PERCENT = 5, 75
MINHASHES = 4
#: Percent of similarity to its leader that puts a node into the leader's group.
NEAR = 40
HOT_FROM, HOT_KEPT = 16, 200_000
#: Percent of a set that, beyond the shortest prefix, is dealt so that the shared part can be counted.
SHARE = 15
#: Nodes in a chunk of a group, queries that meet it at once.
CHUNK = 256
#: Nodes that share a shingle and are paired where they meet; more go through their groups first.
FEW = 16
#: Bytes of text whose shingles make a bucket.
SPLIT_BYTES = 24 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and, sorted within each, the distinct 64-bit hashes of its shingles."""
    ends, codes, words = word_codes(texts)
    of_word = mixed(hashes(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    length = np.diff(ends)
    n = max(len(of_word) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled = rolled * _STEP + of_word[j : j + n]
    rolled = mixed(rolled)
    found = []
    for a, words_in in zip(ends[:-1].tolist(), length.tolist(), strict=True):
        if words_in >= size:
            found.append(np.unique(rolled[a : a + words_in - size + 1]))
        elif words_in:
            one = np.uint64(words_in)
            for x in of_word[a : a + words_in]:
                one = np.uint64((int(one) * int(_STEP) + int(x)) & (2**64 - 1))
            found.append(mixed(np.array([one])))
        else:
            found.append(np.zeros(0, np.uint64))
    return np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64), np.concatenate(found) if found else np.zeros(0, np.uint64)


def _over(values: np.ndarray, ends: np.ndarray, how: np.ufunc) -> np.ndarray:
    """`how` over each part that isn't empty, 0 for others."""
    out = np.zeros(len(ends) - 1, values.dtype)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = how.reduceat(values, ends[full])
    return out


def node_ids(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mixed(_over(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), ends, np.add) + np.diff(ends).astype(np.uint64)).view(np.int64)


def named(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, rising with it, and 32 bits that name it there. Two hashes may share a name; sets are compared later."""
    return ((values >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64), (values >> np.uint64(12)).astype(np.uint32)


def _full_names(values: np.ndarray, buckets: int) -> np.ndarray:
    bucket, name = named(values, buckets)
    return (bucket << 32) | name


def packed(names: np.ndarray) -> bytes:
    """Sorted names as gaps, those bytes of each place of a number together, compressed."""
    gaps = np.diff(names, prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32), dtype=np.uint32)


def sketches(docs: DataFrame, buckets: int, tokens_each: int = 2 << 20) -> DataFrame:
    """doc_id, text_key (hash of the text), n, node and min-hashes of each document; in rows of their own, bucket and names of all shingles.

    One pass over the texts gives both: the names, once for each document that has them, are what `frequent` counts.
    """
    out = "doc_id long, text_key long, n long, node long, mins array<long>, bucket int, names binary"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def batch_of(rows: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        full = np.sort(_full_names(np.concatenate(parts), buckets))
        name, cuts = full.astype(np.uint32), np.searchsorted(full, np.arange(buckets + 1, dtype=np.int64) << 32)
        some = np.flatnonzero(np.diff(cuts))
        return batch_of(len(some), bucket=pa.array(some, pa.int32()), names=pa.array([packed(name[cuts[b] : cuts[b + 1]]) for b in some.tolist()], pa.binary()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ends, values = shingle_sets(texts_of(batch, "text"))
                mins = np.stack([_over(mixed(values ^ np.uint64(17 + 1_000_003 * i)), ends, np.minimum) for i in range(MINHASHES)], 1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, mins.size + 1, MINHASHES, dtype=np.int32), mins.ravel()).cast(schema.field("mins").type)
                yield batch_of(batch.num_rows, doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), n=pa.array(np.diff(ends)), node=pa.array(node_ids(ends, values)), mins=lists)
                parts.append(values)
                held += len(values)
                if held >= tokens_each:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(sketch, out)


def _dealt(docs: DataFrame, wanted, buckets: int, tokens_each: int = 1 << 20) -> DataFrame:
    """Shingles that `wanted(ends, values)` marks, dealt by bucket: blobs of names and of what nodes they are of.

    A blob's places point into its table of nodes and their set sizes.
    """
    out = "bucket int, names binary, places binary, nodes binary, sizes binary"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        values, places, nodes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(values)
        places = places[order]
        bucket, name = named(values[order], buckets)
        cuts, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[b], cuts[b + 1]
            used, local = np.unique(places[i:j], return_inverse=True)
            rows.append((b, name[i:j].tobytes(), local.astype(np.uint32).tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, sets_in = [], 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ends, values = shingle_sets(texts_of(batch, "text"))
                mask = wanted(ends, values)
                if mask.any():
                    place = np.repeat(np.arange(sets_in, sets_in + len(ends) - 1), np.diff(ends))[mask]
                    parts.append((values[mask], place, node_ids(ends, values), np.diff(ends).astype(np.int32)))
                    sets_in += len(ends) - 1
                    held += len(place)
                if held >= tokens_each:
                    yield emit(parts)
                    parts, held, sets_in = [], 0, 0
        if held:
            yield emit(parts)

    return docs.select("text").mapInArrow(deal, out)


def frequent(dealt: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Full names of the most frequent shingles of `dealt` (bucket, names), sorted, and each one's place by frequency; HOT_KEPT at most, whatever the corpus."""
    out = "name long, n long"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def count(rows: pa.Table) -> pa.Table:
        name, n = np.unique(np.concatenate([unpacked(x.as_buffer()) for x in rows.column("names")]), return_counts=True)
        keep = n >= HOT_FROM
        full = (np.int64(rows.column("bucket")[0].as_py()) << 32) | name[keep].astype(np.int64)
        return pa.table({"name": full, "n": n[keep].astype(np.int64)}, schema=schema)

    top = dealt.groupBy("bucket").applyInArrow(count, out).orderBy(F.col("n").desc(), "name").limit(HOT_KEPT).toPandas()
    names, n = top["name"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, n))] = np.arange(len(names))
    order = np.argsort(names)
    return names[order], place[order]


def prefix_mask(ends: np.ndarray, values: np.ndarray, buckets: int, hot: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles of each set: those not frequent by hash, then the frequent by frequency.

    Of those, a linked set has as many as `SHARE` says.
    """
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    late, at = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    if len(hot):
        full = _full_names(values, buckets)
        at = np.minimum(np.searchsorted(hot, full), len(hot) - 1)
        late = hot[at] == full
    seen = np.concatenate([[0], np.cumsum(~late)])  # hashes are sorted within a set already
    early = seen[ends[1:]] - seen[ends[:-1]]
    rank = seen[:-1] - seen[ends[:-1]][owner]
    behind = np.flatnonzero(late)
    behind = behind[np.lexsort((place[at[behind]], owner[behind]))] if len(behind) else behind
    own, late_in = owner[behind], size - early
    first = np.concatenate([[0], np.cumsum(late_in)])[:-1]
    rank[behind] = early[own] + np.arange(len(behind)) - first[own]
    keep = size - (size * PERCENT + 99) // 100 + 1 + size * SHARE // 100
    return rank < keep[owner]


def meetings(docs: DataFrame, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Who meets at a prefix shingle: pairs (a, b) and how often, where few do; name and a, where more do."""
    out = "a long, b long, times long, name long"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # twice HOT_KEPT numbers at most
    wanted = lambda ends, values: prefix_mask(ends, values, buckets, *shared.value)

    def meet(rows: pa.Table) -> pa.Table:
        name, nodes, sizes = [], [], []
        for n, p, x, s in zip(*(rows.column(c) for c in ("names", "places", "nodes", "sizes")), strict=True):
            place = np.frombuffer(p.as_buffer(), np.uint32)
            name.append(np.frombuffer(n.as_buffer(), np.uint32))
            nodes.append(np.frombuffer(x.as_buffer(), np.int64)[place])
            sizes.append(np.frombuffer(s.as_buffer(), np.int32)[place])
        name, nodes, sizes = np.concatenate(name), np.concatenate(nodes), np.concatenate(sizes)
        order = np.argsort(name, kind="stable")
        again = np.diff(name[order]) == 0
        order = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]  # most shingles stand alone
        order = order[np.lexsort((nodes[order], name[order]))]
        name, nodes, sizes = name[order], nodes[order], sizes[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (nodes[1:] != nodes[:-1])
        name, nodes, sizes = name[new], nodes[new], sizes[new]
        _, start, count = np.unique(name, return_index=True, return_counts=True)
        pairs = [np.zeros((0, 2), np.int64)]
        for m in range(2, FEW + 1):
            at = start[count == m]
            i, j = np.triu_indices(m, 1)
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = 100 * np.minimum(sizes[left], sizes[right]).astype(np.int64) >= PERCENT * np.maximum(sizes[left], sizes[right]).astype(np.int64)
            pairs.append(np.stack([nodes[left[fits]], nodes[right[fits]]], 1))
        both = pd.DataFrame(np.concatenate(pairs), columns=["a", "b"]).groupby(["a", "b"], sort=False).size().reset_index(name="times")
        many = np.repeat(count > FEW, count)
        full = (np.int64(rows.column("bucket")[0].as_py()) << 32) | name[many].astype(np.int64)
        gap = lambda n: pa.nulls(n, pa.int64())
        columns = [pa.concat_arrays([pa.array(both["a"].to_numpy(np.int64)), pa.array(nodes[many])])]
        columns += [pa.concat_arrays([pa.array(both[c].to_numpy(np.int64)), gap(len(full))]) for c in ("b", "times")]
        return pa.table([*columns, pa.concat_arrays([gap(len(both)), pa.array(full)])], schema=schema)

    return _dealt(docs, wanted, buckets).groupBy("bucket").applyInArrow(meet, out)


def _overlap(sorted_set: np.ndarray, other: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(sorted_set, other), len(sorted_set) - 1)
    return int((sorted_set[at] == other).sum())


def _sets(rows: pa.Table) -> dict[int, np.ndarray]:
    """Node to set; rows whose text has another set than the node's are left out."""
    found: dict[int, np.ndarray] = {}
    for batch in rows.combine_chunks().to_batches():
        for part in slices(batch, "text"):
            ends, values = shingle_sets(texts_of(part, "text"))
            for node, own, a, b in zip(part.column("node").to_pylist(), node_ids(ends, values).tolist(), ends[:-1], ends[1:], strict=True):
                if node == own and b > a:
                    found[node] = values[a:b]
    return found


def opened(members: pa.Table, queries: pa.Table, least: int) -> list[tuple[int, int, bool]]:
    """What queries find in a group: query, member and whether they link, for similarities of `least` percent and more.

    First the group's union bounds what a query may share with any member; only if that is enough are members compared. Marks
    name what is linked already; links found here join marks, and whoever is joined to the query is passed over.
    """
    inside, asked = _sets(members), _sets(queries)
    if not inside or not asked:
        return []
    mark = dict(zip(members.column("node").to_pylist(), members.column("mark").to_pylist(), strict=True))
    own_mark = dict(zip(queries.column("node").to_pylist(), queries.column("mark").to_pylist(), strict=True))
    union = np.unique(np.concatenate(list(inside.values())))
    found, parent = [], {}

    def root(x: int) -> int:
        while (above := parent.get(x, x)) != x:
            parent[x] = parent.get(above, above)
            x = above
        return x

    for q, own in asked.items():
        if 100 * _overlap(union, own) < least * len(own):
            continue
        for m, other in inside.items():
            if root(mark[m]) == root(own_mark[q]) or 100 * min(len(own), len(other)) < least * max(len(own), len(other)):
                continue
            both = _overlap(other, own)
            linked = 100 * both >= PERCENT * (len(own) + len(other) - both)
            if linked or 100 * both >= least * (len(own) + len(other) - both):
                found.append((q, m, linked))
                if linked:
                    parent[root(mark[m])] = root(own_mark[q])
    return found


def links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, members: DataFrame, least: int = PERCENT) -> DataFrame:
    """a, b, linked among `candidates` (query, mark, grp) by opening groups of `members` (grp, node, mark).

    `nodes`: node, doc_id, text_key, where its text is found. Groups are cut into chunks, queries into salts, so
    that a task holds 2 * CHUNK texts at a time.
    """
    sizes = candidates.groupBy("grp").agg(F.count("*").alias("n_queries")).join(members.groupBy("grp").agg(F.count("*").alias("n_members")), "grp")
    sizes = sizes.select("grp", F.ceil(F.col("n_queries") / CHUNK).cast("int").alias("salts"), F.ceil(F.col("n_members") / CHUNK).cast("int").alias("chunks"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(sizes, "grp").select("grp", "node", "mark", part("node", "chunks").alias("chunk"), every("salts").alias("salt"))
    right = candidates.join(sizes, "grp").select("grp", F.col("query").alias("node"), "mark", part("query", "salts").alias("salt"), every("chunks").alias("chunk"))
    left, right = written(left, "members"), written(right, "queries")
    place = left.select("node").union(right.select("node")).distinct().join(nodes, "node")
    both = lambda c: F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = written(keyed.alias("d").join(place.alias("p"), both("doc_id") & both("text_key")).select("node", "text"), "texts")
    keys, out = ["grp", "chunk", "salt"], "a long, b long, linked boolean"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def look(members: pa.Table, queries: pa.Table) -> pa.Table:
        found = opened(members, queries, least) if members.num_rows and queries.num_rows else []
        return pa.table([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

    again = texts.select(*[F.col(c).alias(c) for c in texts.columns])  # columns of its own, so that the two sides can be told apart
    return left.join(texts, "node").groupBy(*keys).cogroup(right.join(again, "node").groupBy(*keys)).applyInArrow(look, out)


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n and class of each row of `docs` (doc_id, text); class is null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = tasks(docs.sparkSession, size, SPLIT_BYTES)
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "sketches")
    made = sketches(docs, buckets).withColumn("dealt", F.col("bucket").isNotNull())
    made.write.option("compression", "zstd").partitionBy("dealt").parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    seen, dealt = stored.where("NOT dealt").drop("bucket", "names", "dealt"), stored.where("dealt").select("bucket", "names")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = seen.where("n > 0").groupBy("node").agg(first.alias("at"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    nodes = written(nodes.select("node", "at.doc_id", "at.text_key", "n", "mins"), "nodes")
    where = nodes.select("node", "doc_id", "text_key")

    # Whoever shares a min-hash is compared with one leader: the node whose min-hashes are shared most, the least edited copy.
    mins = nodes.select("node", "n", F.posexplode("mins").alias("i", "value"))
    shared = mins.groupBy("i", "value").agg(F.count("*").alias("k")).where("k > 1")
    mins = written(mins.join(shared, ["i", "value"]), "mins")
    known = mins.groupBy("node").agg(F.sum("k").alias("fame"))
    mins = mins.join(known, "node")
    leaders = mins.groupBy("i", "value").agg(F.max(F.struct("fame", "node", "n")).alias("lead"))
    stars = mins.join(leaders, ["i", "value"]).where(f"node <> lead.node AND 100 * least(n, lead.n) >= {NEAR} * greatest(n, lead.n)")
    stars = written(stars.groupBy(F.col("node").alias("query"), F.col("lead.node").alias("grp")).agg(F.first("lead.fame").alias("fame")), "stars")
    heads = stars.select("grp", F.col("grp").alias("node"), F.col("grp").alias("mark")).distinct()
    near = written(links(docs, where, stars.select("query", F.col("query").alias("mark"), "grp"), heads, NEAR), "near")
    marks = components(near.where("linked"))
    homes = near.join(stars, (near["a"] == stars["query"]) & (near["b"] == stars["grp"])).groupBy("query").agg(F.max(F.struct("fame", "grp"))["grp"].alias("home"))
    place = nodes.select("node").join(marks.select("node", F.col("component").alias("mark")), "node", "left").join(homes.select(F.col("query").alias("node"), "home"), "node", "left")
    place = written(place.select("node", F.coalesce("mark", "node").alias("mark"), F.coalesce("home", "node").alias("home")), "places")

    hot = frequent(dealt)
    removed(spark, f"{path}/dealt=true")  # nothing reads it again
    met = written(meetings(docs, buckets, hot), "meetings")
    pairs = written(met.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("times").alias("times")), "pairs")
    many = met.where("b IS NULL").select("a", "name")
    bound = 1 + F.floor(F.col("n") * (SHARE * PERCENT) / 10_000)
    # Who shares less with all others together than a link takes has none.
    one = F.lit(1).cast("bigint")
    touched = pairs.select(F.col("a").alias("node"), "times").union(pairs.select("b", "times")).union(many.select("a", one)).groupBy("node").agg(F.sum("times").alias("times"))
    alive = written(touched.join(nodes.select("node", "n"), "node").where(F.col("times") >= bound).select("node", "n"), "alive")
    living = lambda df, c: df.join(alive.select(F.col("node").alias(c)), c, "left_semi")
    many = written(living(many, "a"), "many")
    # Of each crowd the group with the most nodes gets a vote from everyone in it; enough votes move a node there.
    crowds = many.join(place.select(F.col("node").alias("a"), "home"), "a").groupBy("name", "home").agg(F.count("*").alias("k")).groupBy("name").agg(F.max(F.struct("k", "home"))["home"].alias("to"))
    votes = many.join(crowds, "name").groupBy("a", "to").agg(F.count("*").alias("k")).groupBy("a").agg(F.max(F.struct("k", "to")).alias("v"))
    moved = votes.join(alive.withColumnRenamed("node", "a"), "a").where(F.col("v.k") >= bound).select(F.col("a").alias("node"), F.col("v.to").alias("to"))
    place = written(place.join(moved, "node", "left").select("node", "mark", F.coalesce("to", "home").alias("home")), "places")
    of = lambda c: place.select(F.col("node").alias(c), F.col("mark").alias(f"mark_{c}"), F.col("home").alias(f"home_{c}"))
    pairs = living(living(pairs, "a"), "b").join(of("a"), "a").join(of("b"), "b").where("mark_a <> mark_b")
    low = F.col("home_a") <= F.col("home_b")
    pairs = pairs.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("query"), F.when(low, F.col("mark_a")).otherwise(F.col("mark_b")).alias("mark"), F.greatest("home_a", "home_b").alias("grp"), "times")
    many = many.join(of("a"), "a")
    there = many.groupBy("name", F.col("home_a").alias("grp")).agg(F.min("mark_a").alias("low"), F.max("mark_a").alias("high"))
    crowd = many.join(there, "name").where("home_a <= grp AND NOT (low = mark_a AND high = mark_a)").groupBy(F.col("a").alias("query"), F.col("mark_a").alias("mark"), "grp").agg(F.count("*").alias("times"))
    # Two members that hold one shingle count twice: too much never excludes a group.
    summed = pairs.union(crowd).groupBy("query", "mark", "grp").agg(F.sum("times").alias("times")).join(nodes.select(F.col("node").alias("query"), "n"), "query")
    candidates = written(summed.where(F.col("times") >= bound).select("query", "mark", "grp"), "candidates")
    inside = place.select(F.col("home").alias("grp"), "node", "mark").join(candidates.select("grp").distinct(), "grp", "left_semi")
    far = links(docs, where, candidates, inside)

    whole = components(near.where("linked").select("a", "b").union(far.select("a", "b")))
    return seen.join(whole, "node", "left").select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text)."""
    found = written(classed(docs), "classes")
    least = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return found.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a lesser doc_id (null last; equal ones: a lesser hash of the text).

    Rows that equal one another in doc_id and text count once, whichever stays. Documents with empty sets all stay.
    """
    found = written(classed(docs), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = found.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("kept"))
    gone = found.join(kept, "class").where(order != F.col("kept")).select("doc_id", "text_key").distinct()
    # Whole rows are carried along in one column, whatever their columns' names.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.struct(*docs.columns).alias("row"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.key").eqNullSafe(F.col("g.text_key"))
    left = keyed.alias("d").join(gone.alias("g"), same, "left_anti")
    if found.where("class IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        whole = F.coalesce(F.col("row.text"), F.lit("")).rlike(WORD)
        left = left.where(whole).dropDuplicates(["doc_id", "key"]).unionByName(left.where(~whole))
    return left.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
ones AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM ones a JOIN ones b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON r.other = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
"""
