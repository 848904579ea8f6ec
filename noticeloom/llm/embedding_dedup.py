"""Embedding near-duplicates by range search in robust-pruned flat graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from noticeloom.llm.common import components, cut

THRESHOLD = 0.93
CAPACITY, PART_BYTES, MAX_TASKS = 16_384, 32 << 20, 5000
TARGET = 256
APART = 0.75
DEGREE, LINKED = 24, 72
STARTS = 1024
ALPHA = 1.2
BEAMS = (64, 160)
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
AUDIT = 400
RECALL = 0.95
MAX_CENTROIDS = 8192


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prune(d_pool: np.ndarray, among: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning of many points at once. d_pool (B x P): distances to each point's candidates
    (inf: none); among (B x P x P): distances between them. Takes the nearest candidate and drops
    those that it is ALPHA times nearer to than the point is; returns chosen columns, -1 padded."""
    alive = np.isfinite(d_pool)
    rows = np.arange(len(d_pool))
    out = np.full((len(d_pool), degree), -1)
    for r in range(degree):
        d = np.where(alive, d_pool, np.inf)
        k = d.argmin(1)
        ok = np.isfinite(d[rows, k])
        if not ok.any():
            break
        out[ok, r] = k[ok]
        alive &= ~((ALPHA * among[rows, k] <= d_pool) & ok[:, None])
        alive[rows, k] = False
    return out


def search(q: np.ndarray, x: np.ndarray, adj: np.ndarray, entry: int | np.ndarray, beam: int, radius: float | None):
    """Greedy best-first search of each query row from `entry` (a node, or a column of one for each query),
    several nodes a step, until the `beam` best seen are all expanded; then every seen node within `radius`
    is expanded in turn, until the range grows no more. A step costs the beam and what it sees, not the
    graph. Returns the cosines seen (queries x nodes; -inf: not seen)."""
    n, b = len(x), len(q)
    cos = np.full((b, n), -np.inf)
    flat, last = cos.reshape(-1), np.empty(b * n, np.int32)
    wide, few = min(beam, n), min(4, beam, n)
    entry = np.broadcast_to(entry, (b, 1))[:, 0]
    node, best, done = np.repeat(entry[:, None], wide, 1), np.full((b, wide), -np.inf), np.ones((b, wide), bool)
    best[:, 0] = flat[np.arange(b) * n + entry] = np.einsum("ij,ij->i", q, x[entry])
    done[:, 0] = False

    def expand(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) of the neighbours not seen before, each once."""
        near = adj[at]
        key = (who[:, None] * n + near)[near >= 0]
        key = key[flat[key] == -np.inf]
        turn = np.arange(len(key), dtype=np.int32)
        last[key] = turn
        key = key[last[key] == turn]
        w, v = np.divmod(key, n)
        for a in range(0, len(key), 1 << 13):
            part = slice(a, a + (1 << 13))
            flat[key[part]] = np.einsum("ij,ij->i", q[w[part]], x[v[part]])
        return w, v, flat[key]

    live = np.arange(b)
    while True:
        todo = np.where(done[live], -np.inf, best[live])
        k = np.argpartition(-todo, few - 1, axis=1)[:, :few]
        ok = np.isfinite(np.take_along_axis(todo, k, 1))
        some = ok.any(1)
        live, k, ok = live[some], k[some], ok[some]
        if not len(live):
            break
        r, c = np.nonzero(ok)
        done[live[r], k[r, c]] = True
        w, v, got = expand(live[r], node[live[r], k[r, c]])
        first = np.searchsorted(w, live)
        more = int((np.searchsorted(w, live, "right") - first).max())
        row = np.searchsorted(live, w)
        slot = wide + np.arange(len(w)) - first[row]
        both = [np.pad(t[live], ((0, 0), (0, more)), constant_values=e) for t, e in ((best, -np.inf), (node, 0), (done, True))]
        for t, e in zip(both, (got, v, False), strict=True):
            t[row, slot] = e
        keep = np.argpartition(-both[0], wide - 1, axis=1)[:, :wide]
        best[live], node[live], done[live] = (np.take_along_axis(t, keep, 1) for t in both)
    if radius is not None:
        opened = np.zeros(b * n, bool)
        opened[(np.arange(b)[:, None] * n + node)[done & np.isfinite(best)]] = True
        key = np.flatnonzero(flat >= radius)
        key = key[~opened[key]]
        while len(key):
            opened[key] = True
            w, v, got = expand(*np.divmod(key, n))
            key = (w * n + v)[got >= radius]
    return cos


def starts(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query the nearest of a few nodes, to start from."""
    some = np.unique(np.linspace(0, len(x) - 1, min(len(x), STARTS)).astype(int))
    return some[(q @ x[some].T).argmax(1)][:, None]


def in_rows(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n rows of the values of ascending row numbers, -1 padded."""
    count = np.bincount(row, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = value
    return out


def build(x: np.ndarray, beam: int = 48) -> np.ndarray:
    """Adjacency (n x DEGREE, -1 padded) of a robust-pruned graph, by inserting batches of an eighth of
    it: each batch searches the graph so far, prunes what it saw, and is linked back."""
    n = len(x)
    adj = np.full((n, DEGREE), -1)
    if n <= 1:
        return adj
    order = np.random.default_rng(3).permutation(n)
    y = x[order]
    g = np.full((n, DEGREE), -1)

    def pruned(points: np.ndarray, pool: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), DEGREE), int)
        for at in range(0, len(points), 128):
            p, part = points[at : at + 128], pool[at : at + 128]
            c = y[np.maximum(part, 0)]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("bpd,bd->bp", c, y[p]), 0))
            d[part < 0] = np.inf
            among = np.sqrt(np.maximum(2 - 2 * (c @ c.transpose(0, 2, 1)), 0))
            k = prune(d, among)
            out[at : at + 128] = np.where(k >= 0, np.take_along_axis(part, np.maximum(k, 0), 1), -1)
        return out

    done = min(n, DEGREE)
    start = np.tile(np.arange(done), (done, 1))
    start[np.arange(done), np.arange(done)] = -1
    g[:done] = pruned(np.arange(done), start)
    while done < n:
        new = np.arange(done, min(n, done + max(DEGREE, done // 8)))
        for at in range(0, len(new), 256):
            own = new[at : at + 256]
            cos = search(y[own], y[:done], g[:done], starts(y[own], y[:done]), beam, None)
            size = min(beam * 2, done)
            pool = np.argpartition(-cos, size - 1, axis=1)[:, :size]
            pool[~np.isfinite(np.take_along_axis(cos, pool, 1))] = -1
            g[own] = pruned(own, pool)
        dst, src = g[new].ravel(), np.repeat(new, DEGREE)
        dst, src = dst[dst >= 0], src[dst >= 0]
        near = np.concatenate([np.einsum("ij,ij->i", y[src[a : a + 8192]], y[dst[a : a + 8192]]) for a in range(0, len(dst), 8192)])
        o = np.lexsort((-near, dst))
        src, dst = src[o], dst[o]
        # a node with very many new links takes the nearest of them
        few = np.arange(len(dst)) - np.searchsorted(dst, dst) < LINKED
        heads, row = np.unique(dst[few], return_inverse=True)
        pools = np.concatenate([g[heads], in_rows(row, src[few], len(heads))], axis=1)
        pools = np.take_along_axis(pools, np.argsort(pools < 0, axis=1, kind="stable"), 1)
        size = (pools >= 0).sum(1)
        g[heads] = pools[:, :DEGREE]
        for low, high in ((DEGREE, 32), (32, 48), (48, DEGREE + LINKED)):
            at = np.flatnonzero((size > low) & (size <= high))
            g[heads[at]] = pruned(heads[at], pools[at, :high])
        done = new[-1] + 1
    adj[order] = np.where(g >= 0, order[np.maximum(g, 0)], -1)
    return adj


def deal(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home (nearest centroid) of each row of x, and the clusters it is dealt to (rows x clusters):
    its home i and each cluster j < i that can be home to a vector linked with it. Such a vector y has
    y . (c_i - c_j) <= 0 and lies within acos(THRESHOLD) of x, hence
    x . (c_i - c_j) <= sin(acos(THRESHOLD)) * |c_i - c_j|; other clusters need not see x. So both ends of
    every link are dealt to the lower of their homes."""
    home, dealt = np.zeros(len(x), int), np.zeros((len(x), len(c)), bool)
    number = np.arange(len(c))
    for at in range(0, len(x), 256):
        cos = x[at : at + 256] @ c.T
        i = cos.argmax(1)
        apart = np.sqrt(np.maximum(2 - 2 * (c[i] @ c.T), 0))
        near = cos.max(1, keepdims=True) - cos <= np.sqrt(1 - THRESHOLD**2) * apart + 1e-9
        home[at : at + 256], dealt[at : at + 256] = i, (number == i[:, None]) | (near & (number < i[:, None]))
    return home, dealt


def means_of(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids of x by spherical k-means. Of centroids nearer than APART (cosine) only the
    fullest stays: a dense ball of near copies, cut up, would be dealt whole to each of its cuts."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        total_by = np.zeros_like(c)
        np.add.at(total_by, near, x)
        full = np.sqrt((total_by**2).sum(1)) > 0
        c[full] = unit(total_by[full])
    kept: list[int] = []
    for i in np.argsort(-np.bincount((x @ c.T).argmax(1), minlength=k)).tolist():
        if not kept or (c[kept] @ c[i]).max() < APART:
            kept.append(i)
    return c[kept]


def centroids(sample: list, total: int) -> dict:
    """Centroids of the sampled rows of each (label, dimension): one for about TARGET vectors, or for
    four, sixteen, ... times as many, or none, whichever makes deal() and the pairing of parts copy the
    fewest rows by the sample. Vectors without structure are dealt nearly everywhere, and one cluster,
    whose parts all meet, is then the cheapest. Groups that the sample lacks are one cluster each."""
    groups: dict = {}
    for r in sample:
        groups.setdefault((r.label, len(r.vec)), []).append(r.vec)
    out, rng = {}, np.random.default_rng(1)
    for key, rows in groups.items():
        x = unit(np.array(rows, float))
        scale = total / len(sample)
        k = int(min(-(-len(rows) * scale // TARGET), max(1, len(rows) // 4), max(1, MAX_CENTROIDS * len(rows) // len(sample))))
        least = len(rows) * scale * np.ceil(len(rows) * scale / capacity(key[1]))
        while k >= 2:
            c = means_of(x, k, rng)
            held = deal(x, c)[1].sum(0) * scale
            copied = (held * np.ceil(held / capacity(key[1]))).sum()
            if copied < least:
                least, out[key] = copied, c
            k //= 4
    return out


def capacity(dim: int) -> int:
    """Vectors of a part: CAPACITY, or as many as PART_BYTES hold."""
    return max(1, min(CAPACITY, PART_BYTES // (8 * dim)))


def vectors_of(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.astype(np.float64).reshape(len(column), -1))


def sampled(reps: DataFrame) -> list[Row]:
    """label and vec of at most SAMPLE vectors (smallest hashes), and of SAMPLE_BYTES at most, sent as
    packed single-precision numbers."""
    longest = reps.agg(F.max(F.size("vec"))).first()[0] or 1
    some = reps.select("label", "vec", F.xxhash64("k").alias("h")).orderBy("h").limit(max(256, min(SAMPLE, SAMPLE_BYTES // (4 * longest))))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            vec = b.column(1)
            ends, flat = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["label", "vec"])

    return [Row(label=r.label, vec=np.frombuffer(r.vec, np.float32)) for r in some.select("label", "vec").mapInArrow(pack, "label int, vec binary").collect()]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest number of each row's component, where root has it without the pairs a, b."""
    ends = np.unique(np.stack([root[a], root[b]], 1)[root[a] != root[b]], axis=0)
    ends = np.concatenate([ends, ends[:, ::-1]])
    own = np.arange(len(root))
    while len(ends):
        low = own.copy()
        np.minimum.at(low, ends[:, 0], own[ends[:, 1]])
        low = low[low]
        if (low == own).all():
            break
        own = low
    return own[root]


def links(reps: DataFrame, beam: int | None) -> tuple[DataFrame, DataFrame]:
    """(k, links, others) and (a, b) of distinct vectors reps(k, id, weight, label, vec): links counts rows,
    others distinct vectors. Without a beam the parts are compared whole, and no link is missed."""
    spark, total = reps.sparkSession, reps.count()
    means = spark.sparkContext.broadcast(centroids(sampled(reps), total))  # MAX_CENTROIDS vectors at most

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            label, vec = b.column(3).to_pylist(), b.column(4)
            size = np.diff(vec.offsets.to_numpy())
            home, own = np.zeros(b.num_rows, np.int32), [[0]] * b.num_rows
            for key in set(zip(label, size.tolist(), strict=True)):
                c = means.value.get(key)
                if c is None:
                    continue
                at = np.flatnonzero([x == key for x in zip(label, size.tolist(), strict=True)])
                for a in range(0, len(at), 256):
                    part = at[a : a + 256]
                    home[part], dealt = deal(vectors_of(vec.take(pa.array(part))), c)
                    for i, row in zip(part, dealt, strict=True):
                        own[i] = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(own, pa.list_(pa.int32()))], ["k", "id", "weight", "label", "vec", "home", "near"])

    # single-precision numbers stay so until they are computed with
    kind = "array<float>" if reps.schema["vec"].dataType == ArrayType(FloatType()) else "array<double>"
    base = f"k long, id long, weight long, label int, vec {kind}"
    dealt = reps.select("k", "id", "weight", "label", F.col("vec").cast(kind).alias("vec")).mapInArrow(assign, base + ", home int, near array<int>")
    dealt = cut(dealt.withColumn("dim", F.size("vec")).withColumn("cluster", F.explode("near")).drop("near"))
    held = F.greatest(F.lit(1), F.least(F.lit(CAPACITY), F.floor(F.lit(PART_BYTES) / (F.col("dim") * 8))))
    parts = dealt.groupBy("label", "dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("parts"))
    # tasks of few parts: what a part or a pair of parts costs is not seen by its size
    tasks = [max(spark.sparkContext.defaultParallelism, min(MAX_TASKS, 4 * (n or 0))) for n in parts.agg(F.sum("parts").cast("long"), F.sum(F.col("parts") * (F.col("parts") + 1) / 2).cast("long")).first()]
    dealt = dealt.join(parts, ["label", "dim", "cluster"]).withColumn("own", F.pmod("k", F.col("parts").cast("long")).cast("int"))

    def graph(key, t):
        import pyarrow as pa

        k = t.column("k").to_numpy()
        adj = build(vectors_of(t.column("vec").combine_chunks()))
        # half of a neighbour's number names it: two of one name are an edge too many, and cosines decide
        ends = np.concatenate([[0], np.cumsum((adj >= 0).sum(1))]).astype(np.int32)
        return pa.table({"k": k, "adj": pa.ListArray.from_arrays(pa.array(ends), pa.array(k.astype(np.int32)[adj[adj >= 0]]))})

    shard = ["label", "dim", "cluster", "own"]
    if beam is None:
        whole = dealt.withColumn("adj", F.array().cast("array<int>"))
    else:
        edges = dealt.repartition(tasks[0], *shard).groupBy(*shard).applyInArrow(graph, "k long, adj array<int>")
        united = edges.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))
        whole = dealt.join(united, "k")
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = whole.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def ranges(key, t):
        import pyarrow as pa

        cluster, i, j = (key[c].as_py() for c in (2, 3, 4))
        k, ids, weight, own, home = (t.column(c).to_numpy() for c in ("k", "id", "weight", "own", "home"))
        x = vectors_of(t.column("vec").combine_chunks())
        lists = t.column("adj").combine_chunks()
        name = k.astype(np.int32)
        by = np.argsort(name, kind="stable")
        src, dst = np.repeat(np.arange(len(k)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(name[by], dst), len(k) - 1)
        known = name[by[at]] == dst
        src, dst = src[known], by[at[known]]
        rows = {p: np.flatnonzero(own == p) for p in (i, j)}

        def hits(mine: int, theirs: int) -> Iterator:
            """For 256 rows of the part `mine` at a time, whether each row of the part `theirs` is in range."""
            q, v = rows[mine], rows[theirs]
            inside = np.full(len(k), -1)
            inside[v] = np.arange(len(v))
            edge = (inside[src] >= 0) & (inside[dst] >= 0)
            adj, y = in_rows(inside[src[edge]], inside[dst[edge]], len(v)), x[v]
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                if beam is None:
                    yield x[part] @ y.T >= THRESHOLD
                else:
                    yield search(x[part], y, adj, inside[part][:, None] if mine == theirs else starts(x[part], y), beam, THRESHOLD) >= THRESHOLD

        number, others, root = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.arange(len(k))
        if len(rows[i]) and len(rows[j]):
            # a pair counts if either end finds the other: what one way finds is kept in bits
            back = np.concatenate([np.packbits(h, axis=1) for h in hits(j, i)])
            there = (np.unpackbits(back[at : at + 256], axis=1, count=len(rows[i])) for at in range(0, len(back), 256)) if i == j else hits(i, j)
            for at, hit in zip(range(0, len(rows[i]), 256), there, strict=True):
                here = rows[i][at : at + 256]
                hit = hit.astype(bool) | np.unpackbits(back[:, at // 8 : at // 8 + 32], axis=1, count=len(here)).astype(bool).T
                a, b = np.nonzero(hit)
                a, b = here[a], rows[j][b]
                a, b = a[a != b], b[a != b]
                # several shards may find a pair: it counts in the lower of its homes, which both are dealt to
                counted = np.minimum(home[a], home[b]) == cluster
                for one, two in {False: ((a, b), (b, a)), True: ((a, b),)}[i == j]:
                    np.add.at(number, one[counted], weight[two[counted]])
                    others += np.bincount(one[counted], minlength=len(k))
                root = joined(root, a, b)
        return pa.table({"k": k, "links": number, "others": others, "a": ids, "b": ids[root]})

    pair = ["label", "dim", "cluster", "i", "j"]
    found = cut(whole.repartition(tasks[1], *pair).groupBy(*pair).applyInArrow(ranges, "k long, links long, others long, a long, b long"))
    return found.groupBy("k").agg(F.sum("links").alias("links"), F.sum("others").alias("others")), found.where("a <> b").select("a", "b").distinct()


def audit(reps: DataFrame, counts: DataFrame) -> float:
    """Recall of links against brute force over all rows, estimated from AUDIT vectors with links found
    and AUDIT without (smallest hashes), each kind standing for all of its kind. Links are counted
    between distinct vectors, so copies weigh nothing; the result is the lesser of the share of all
    links and the mean share of a vector, so neither do dense balls hide other vectors."""
    known = reps.select("k", "label", "vec").join(counts.select("k", "others"), "k", "left").withColumn("others", F.coalesce("others", F.lit(0)))
    size = {r[0]: r[1] for r in known.groupBy(F.col("others") > 0).count().collect()}
    q = []
    for kind in size:
        q += known.where((F.col("others") > 0) == F.lit(kind)).withColumn("h", F.xxhash64("k", F.lit(1))).orderBy("h").limit(AUDIT).collect()
    asked = {}
    for r in q:
        asked.setdefault((r.label, len(r.vec)), []).append(r)
    asked = {key: (np.array([r.k for r in rows]), unit(np.array([r.vec for r in rows], float))) for key, rows in asked.items()}

    def brute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: dict[int, int] = {}
        for b in batches:
            label, vec, size = b.column(1).to_pylist(), b.column(2), np.diff(b.column(2).offsets.to_numpy()).tolist()
            for key, (k, x) in asked.items():
                at = np.flatnonzero([p == key for p in zip(label, size, strict=True)])
                if len(at):
                    close = (vectors_of(vec.take(pa.array(at))) @ x.T >= THRESHOLD) & (b.column(0).to_numpy()[at][:, None] != k[None, :])
                    for i, c in zip(k.tolist(), close.sum(0).tolist(), strict=True):
                        n[i] = n.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["k", "n"])

    true = reps.select("k", "label", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(brute, "k long, n long")
    true = {r[0]: r[1] for r in true.groupBy("k").agg(F.sum("n")).collect()}
    return recall_of([(r.others, true[r.k], size[r.others > 0] / min(AUDIT, size[r.others > 0])) for r in q])


def recall_of(asked: list[tuple[int, int, float]]) -> float:
    """Recall by (links found, links there are, vectors it stands for) of each audited vector."""
    got = np.array([(min(f, n), n, w) for f, n, w in asked if n], float)
    if not len(got):
        return 1.0
    f, n, w = got.T
    return float(min((w * f).sum() / (w * n).sum(), (w * f / n).sum() / w.sum()))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row of embeddings.

    Vectors of one (non-null) label and one length link at a cosine (double precision) of 0.93 or
    more. Equal vectors of a label are one node that counts for all its rows, so copies cost nothing.
    Nodes are dealt to their nearest cluster of their label (k-means on a bounded sample) and to all that
    may hold a vector linked with them (see deal), so no link is lost between clusters; clusters over
    CAPACITY are cut into parts, and each pair of parts is searched in its own task, so
    no task holds more than two parts. Each part builds a robust-pruned graph, a node's adjacency
    lists are united over its parts, and every node searches all parts of its clusters, its own from
    itself and others from the nearest of a few nodes, expanding while nodes lie in range. Links are the cosines computed on the way. Recall is
    audited against brute force for a sample; under RECALL the search is made again with a wider beam,
    and at last the parts are compared whole. The dealing is the same each time, as it loses nothing.

    Null, zero, null-holding and non-finite vectors, null labels and null ids have no links, are their
    own component and are kept. Repeated rows are copies of each other.
    """
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vec"))
    d = F.col("vec").cast("array<double>")
    good = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
        & F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(d, lambda v: v != 0),
        F.lit(False),
    )
    e = e.withColumn("k", F.when(good, F.xxhash64("label", "vec")))
    reps = cut(e.where("k IS NOT NULL").groupBy("k", "label", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    for beam in (*BEAMS, None):
        counts, edges = links(reps, beam)
        recall = audit(reps, counts)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"audited recall of links is {recall} after whole comparison")
    found = components(edges)
    nodes = reps.select("k", "id", "weight").join(counts, "k", "left").join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    nodes = nodes.select("k", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = e.select("vec_id", "k").join(nodes, "k", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", F.lit(float(recall)))
