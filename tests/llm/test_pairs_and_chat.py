import hashlib

import numpy as np
from pyspark.sql import Row

from noticeloom.llm import chat, decontaminate, embedding_dedup
from noticeloom.llm.decontaminate import tiles


def ids(text):
    return np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in text.split()], np.uint64)


def test_tiles_find_reordered_passages():
    item = " ".join(f"w{k}" for k in range(40))
    w = item.split()
    doc = " ".join(["x"] * 7 + w[20:40] + ["y"] * 3 + w[0:20] + ["z"])
    got = tiles(ids(doc), ids(item))
    assert sorted(n for _, _, n in got) == [20, 20]
    marked = set()
    for p, t, n in got:
        assert (ids(doc)[p : p + n] == ids(item)[t : t + n]).all()
        assert not marked & set(range(t, t + n))
        marked |= set(range(t, t + n))
    assert tiles(ids("a b c d"), ids("a b c d e")) == []
    assert tiles(ids("p a b q"), ids("a b")) == [(1, 0, 2)]
    assert sum(n for *_, n in tiles(ids("a b c d e " * 9), ids("a b c d e a b c d e"))) == 10


def test_decontamination(spark, docs, no_docs, rows):
    w = rows[6][1].split()
    items = [(0, " ".join(w[5:35])), (1, " ".join(w[30:45] + w[5:20])), (2, "unrelated words that occur nowhere in it"), (3, ""), (4, None), (5, "one two"), (0, " ".join(w[5:35]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    two = {k for k, t, *_ in rows if k is not None and t and "one two" in " ".join(t.lower().split())}
    assert got == {(6, 0), (6, 1)} | {(k, 5) for k in two}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1 - len(two)
    assert all(r.th == "x" and r.doc == 7 for r in clean.collect())
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for label in (0, 1):
        base = rng.normal(size=(30, 16))
        for b in base:
            out.append((label, b))
            for _ in range(3):
                out.append((label, b + rng.normal(size=16) * 0.05))
        out += [(label, base[0])] * 5
    out += [(None, out[0][1]), (0, None), (0, np.zeros(16)), (1, np.full(16, np.nan)), (0, np.ones(4)), (0, np.ones(4))]
    return out


def test_embedding_links_match_brute_force(spark, monkeypatch):
    data = vectors()
    rows = [(k, None if v is None else [float(x) for x in np.float32(v)], lab) for k, (lab, v) in enumerate(data)]
    x = [np.array(r[1], float) if r[1] else None for r in rows]
    ok = [v is not None and r[2] is not None and np.isfinite(v).all() and v.any() for v, r in zip(x, rows, strict=True)]
    n = [0] * len(rows)
    comp = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt(x[i] @ x[i] * (x[j] @ x[j])) >= 0.93]
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for _ in range(len(rows)):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for capacity in (2048, 40):  # one part a cluster, then several
        monkeypatch.setattr(embedding_dedup, "CAPACITY", capacity)
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
        assert len(got) == len(rows) and got[0].audit_recall >= 0.9
        assert [got[k].n_links for k in range(len(rows))] == n
        assert [got[k].component_id for k in range(len(rows))] == comp
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def scattered(n=500, dim=8, seed=8):
    """Unit vectors without structure, each with one partner at a cosine just over the threshold."""
    rng = np.random.default_rng(seed)
    x = embedding_dedup.unit(rng.normal(size=(n, dim)))
    u = rng.normal(size=(n, dim))
    u = embedding_dedup.unit(u - (u * x).sum(1, keepdims=True) * x)
    return np.concatenate([x, 0.935 * x + np.sqrt(1 - 0.935**2) * u])


def test_links_across_many_clusters_match_brute_force(spark, monkeypatch):
    x = scattered()
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    many = embedding_dedup.means_of(x[:200], 50, np.random.default_rng(1))  # a sample fits the other rows less
    home, _ = embedding_dedup.deal(x, many)
    a, b = np.nonzero(hit)
    assert len(many) > 30 and (home[a] != home[b]).mean() > 0.2
    chosen = embedding_dedup.centroids
    for means, capacity in ((lambda *_: {(0, 8): many}, 2048), (chosen, 128)):
        monkeypatch.setattr(embedding_dedup, "centroids", means)
        monkeypatch.setattr(embedding_dedup, "CAPACITY", capacity)
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
        assert [got[k] for k in range(len(x))] == hit.sum(1).tolist()


def test_a_large_part_finds_the_links_of_balls_and_pairs():
    rng = np.random.default_rng(2)
    x = embedding_dedup.unit(rng.normal(size=(3000, 64)))
    x[:300] = embedding_dedup.unit(x[0] + 0.014 * rng.normal(size=(300, 64)))
    x[300:400] = embedding_dedup.unit(x[400:500] + 0.03 * rng.normal(size=(100, 64)))
    x = x[rng.permutation(len(x))]
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    adj, q = embedding_dedup.build(x), np.arange(0, 3000, 3)
    for start in (q[:, None], embedding_dedup.starts(x[q], x)):  # from itself; from the nearest of a few
        got = embedding_dedup.search(x[q], x, adj, start, 64, 0.93)
        seen = np.isfinite(got)
        assert np.allclose(got[seen], (x[q] @ x.T)[seen]) and seen.mean() < 0.5
        found = (got >= 0.93) & hit[q]
        assert found.sum() >= 0.99 * hit[q].sum() and (found.any(1) == hit[q].any(1)).mean() > 0.995


def test_parts_joined_pair_by_pair():
    root = embedding_dedup.joined(np.arange(6), np.array([4, 1]), np.array([5, 2]))
    assert root.tolist() == [0, 1, 1, 3, 4, 4]
    assert embedding_dedup.joined(root, np.array([5, 0]), np.array([2, 0])).tolist() == [0, 1, 1, 3, 1, 1]


def test_poor_searches_end_in_whole_comparison(spark, monkeypatch):
    x = scattered(60)
    n = (x @ x.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)] + [(500 + k, x[0].tolist(), 0) for k in range(900)], "vec_id long, embedding array<double>, label int")
    blind = lambda q, x, adj, entry, beam, radius: np.where(np.arange(len(x)) == entry, q @ x.T, -np.inf)
    monkeypatch.setattr(embedding_dedup, "search", blind)
    monkeypatch.setattr(embedding_dedup, "build", lambda x: np.full((len(x), 1), -1))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    copies = 900 * (x @ x[0] >= 0.93)
    assert [got[k].n_links for k in range(len(x))] == (n + copies).tolist() and got[0].audit_recall == 1


def test_recall_counts_each_kind_and_vector():
    assert embedding_dedup.recall_of([(0, 0, 1.0)]) == 1
    assert embedding_dedup.recall_of([(4, 4, 1.0), (0, 4, 3.0)]) == 0.25
    assert embedding_dedup.recall_of([(1000, 1000, 1.0), (0, 1, 1.0)]) == 0.5
    assert embedding_dedup.recall_of([(500, 1000, 1.0), (1, 1, 9.0)]) < 0.6


def test_embeddings_of_odd_rows_and_columns(spark, monkeypatch):
    """Null ids link with nothing; columns that clash with the operator's own don't disturb it."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE_BYTES", 1)
    rows = [(k, [1.0, k * 0.001, 0.0], 0, 5, "x", 1.0) for k in range(6)] + [(None, [1.0, 0.0, 0.0], 0, 5, "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, k int, n_links string, links double")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(k, 5, 0, k == 0) for k in range(6)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]


def plain_tiling(doc, item, least=5):
    """Words of item covered by greedy string tiling, every start tried at every step."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), 0
    least = max(1, min(least, len(item)))
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out += n
        free_i[i : i + n] = free_d[j : j + n] = [False] * n


def test_decontamination_equals_plain_tiling(spark):
    """Many short documents and items of few words, so that seeds are shared by most of them."""
    rng = np.random.default_rng(12)
    line = "this very common line of words stands nearly everywhere"
    word = lambda: f"w{rng.integers(12)}"
    docs = [(k, " ".join([line] * int(rng.integers(0, 2)) + [word() for _ in range(int(rng.integers(0, 60)))])) for k in range(60)]
    items = [(k, " ".join([line] * int(rng.integers(0, 2)) + [word() for _ in range(int(rng.integers(1, 14)))])) for k in range(25)]
    for k in range(10):  # passages of items, reordered
        w = items[k][1].split()
        docs.append((100 + k, " ".join([*w[len(w) // 2 :], word(), word(), *w[: len(w) // 2]])))
    want = {(d, i) for d, t in docs for i, u in items if plain_tiling(t.split(), u.split()) >= 0.6 * len(u.split())}
    assert 20 < len(want) < len(docs) * len(items) / 2
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_few_clusters_where_vectors_have_structure(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CAPACITY", 64)
    monkeypatch.setattr(embedding_dedup, "TARGET", 8)
    rng = np.random.default_rng(2)
    balls = np.repeat(rng.normal(size=(40, 32)), 10, 0) + rng.normal(size=(400, 32)) * 0.05
    found = embedding_dedup.centroids([Row(label=0, vec=v.tolist()) for v in balls], len(balls))
    dealt = embedding_dedup.deal(embedding_dedup.unit(balls), found[0, 32])[1]
    assert len(found[0, 32]) >= 20 and dealt.sum() < 3 * len(balls)
    assert not embedding_dedup.centroids([Row(label=0, vec=v.tolist()) for v in scattered(100)], 100)


def test_chat_digest_matches_sql(spark):
    import duckdb

    rows = [(1, 0, "user", "hi\\ <|im_end|>\n\\e\\|"), (1, 1, "assistant", "<|x|> <\\| é"), (2, 5, None, None), (2, 5, "assistant", ""), (2, None, "we\nird", "t"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = sorted(map(tuple, chat.digest(df).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()))
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(c.execute(chat.SQL).fetchall())
    assert [r.conv_id for r in chat.digest(df.limit(0)).collect()] == [-1]


def test_layouts_are_told_apart_by_their_paths(spark):
    texts = [
        '{"prompt": "p", "completion": "c"}', '{"instruction": "i", "input": "n", "output": "o", "other": 1}', '{"system": "s", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}', '{"role": "user", "text": "t"}', '{"prompt": "p", "messages": [{"role": "user"}]}', "{broken", None, "{}",
    ]
    got = chat.from_json(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string"), "j").orderBy("k").collect()
    assert [r.layout for r in got] == ["prompt", "instruction", "messages", "conversations", "turn", None, None, None, "turn"]
    assert [[tuple(t) for t in r.turns] for r in got[:4]] == [
        [("user", "p"), ("assistant", "c")], [("user", "i\n\nn"), ("assistant", "o")], [("system", "s"), ("user", "u"), ("assistant", "a")], [("user", "u"), ("assistant", "a")],
    ]
    assert len({r.fingerprint for r in got[:6]}) == 6
