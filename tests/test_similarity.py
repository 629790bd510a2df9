import numpy as np

from pulsegrid.operators import similarity


def _unit(v):
    v = np.asarray(v, dtype=np.float64)
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def test_post_filter_can_hide_true_match_pre_filter_finds_it(spark):
    q = [(100, "o", "svc-a", _unit([1, 0, 0, 0]))]
    idx = [(i, "o", "svc-b", _unit([1, 0.01 * i, 0, 0])) for i in range(1, 6)]
    idx.append((50, "o", "svc-a", _unit([1, 0.2, 0.05, 0])))
    schema = "case_id long, org_id string, service string, vector array<float>"
    qd, idd = spark.createDataFrame(q, schema), spark.createDataFrame(idx, schema)
    post = similarity.dedup_post_filter(qd, idd, threshold=0.9).collect()[0]
    pre = similarity.dedup_pre_filter(qd, idd, threshold=0.9).collect()[0]
    assert post["is_duplicate"] is False and post["score"] is None
    assert pre["is_duplicate"] is True and pre["matched_case_id"] == 50


def test_blocked_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, m[i].astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = similarity.exact_topk(df, df, 3, exclude_self=True, block_rows=7).collect()
    mm = m.astype(np.float32).astype(np.float64)
    s = mm @ mm.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i], kind="stable")[:3]}
    assert {(r["query_id"], r["match_id"]) for r in got} == want


def test_ties_go_to_the_lowest_ids_in_every_block(spark):
    from pulsegrid.operators.similarity import dedup_pre_filter, exact_topk
    rng = np.random.default_rng(4)
    v = [float(x) for x in rng.normal(size=37)]
    rows = [(i, "o", "s", v if i >= 100 else [float(x) for x in rng.normal(size=37) * 0.01]) for i in range(400)]
    rng.shuffle(rows)
    index = spark.createDataFrame([(int(a), str(b), str(c), list(map(float, d))) for a, b, c, d in rows],
                                  "case_id long, org_id string, service string, vector array<double>")
    query = spark.createDataFrame([(9001, "o", "s", v)], index.schema)
    for block in (16, 64, 2048):
        top = exact_topk(query, index, 5, q_id="case_id", i_id="case_id", block_rows=block).orderBy("rank").collect()
        assert [r.match_id for r in top] == [100, 101, 102, 103, 104]
        assert dedup_pre_filter(query, index, threshold=0.5, block_rows=block).first().matched_case_id == 100


def test_adding_to_the_index_equals_a_rebuild(spark):
    """New, changed, moved, emptied, absent and unchanged cases; only changed ones are embedded."""
    from pulsegrid.operators import embed
    schema = "id long, org_id string, primary_service string, signature_text string"
    first = [(i, "o", "s", f"service=s; metrics=[m{i}]") for i in range(12)]
    later = [(0, "o", "s", first[0][3]), (1, "o", "s", "changed text"), (2, "p", "s", first[2][3]), (3, "o", "s", None),
             (40, "o", "s", "new one"), (41, "o", "s", "")]
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(later, schema)
    shape = lambda df: sorted(str(tuple(r)) for r in embed.live_index(df).select("case_id", "org_id", "service", "digest", "vector").collect())
    one = embed.index_changes(None, a, 1, dim=32)
    two = embed.index_changes(one, b, 2, dim=32)
    assert sorted(r["case_id"] for r in two.collect()) == [1, 2, 3, 40, 41]
    index = one.unionByName(two)
    merged = [r for r in first if r[0] > 3] + later
    assert shape(index) == shape(embed.index_changes(None, spark.createDataFrame(merged, schema), 1, dim=32))
    assert embed.index_changes(index, b, 3, dim=32).collect() == []
    whole = index.unionByName(embed.index_changes(index, b, 3, whole=True, dim=32))
    assert shape(whole) == shape(embed.index_changes(None, b, 1, dim=32))
    back = whole.unionByName(embed.index_changes(whole, a, 4, dim=32))
    assert {r["case_id"] for r in embed.live_index(back).collect()} == {*range(12), 40, 41}
    assert shape(embed.index_changes(None, a.limit(0), 1, dim=32)) == []


def test_best_of_tiles_equals_brute_force():
    """Several tiles, ties, repeated ids, a query's own id, not-a-number components."""
    rng = np.random.default_rng(6)
    index = rng.integers(-3, 4, size=(9000, 4)).astype(float)  # many equal scores
    index[17, 0] = np.nan
    ids = np.sort(rng.integers(0, 6000, size=9000))
    queries, qids = np.concatenate([index[5000:5030], rng.normal(size=(600, 4))]), np.concatenate([ids[5000:5030], np.arange(600)])
    for own in (True, False):
        rows, at, score = similarity._best(queries, qids, index, ids, 5, own)
        for q in (*range(0, 40), 300, 629):
            s = index @ queries[q]
            use = np.isfinite(s) & ~(own & (ids == qids[q]))
            want = sorted((-round(v, 9), int(i)) for v, i in zip(s[use], ids[use]))[:5]
            got = sorted((-round(v, 9), int(ids[i])) for i, v in zip(at[rows == q], score[rows == q]))
            assert got == want


def test_blocks_grow_with_their_side(spark):
    """Rows are copied to a number of blocks that does not grow with the table, until blocks reach their bound."""
    from pyspark.sql import functions as F
    side = spark.range(60_000).select(F.lit(0).alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    r = similarity._block_counts(side, side.limit(100), ["k"], "vector", 64).first()
    assert (r["_qb_n"], r["_ib_n"]) == (similarity.SPLIT, 2)


def test_null_ids_find_and_are_found(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.1]), (2, [0.9, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for block in (1, 2048):  # blocks, and the index broadcast
        got = {(r.query_id, r.match_id) for r in similarity.exact_topk(df, df, 3, exclude_self=True, block_rows=block).collect()}
        assert got == {(1, None), (1, 2), (2, 1), (2, None), (None, 1), (None, 2), (None, None)}


def test_a_catalog_is_broadcast_and_no_case_vector_moves(spark):
    from pulsegrid.functions.catalog_data import actions_frame
    from pulsegrid.operators import embed
    cases = spark.createDataFrame([(1, "a b", "c"), (2, None, "restart pool"), (3, "x", None)], "id long, title string, ai_summary string")
    out = embed.match_actions(cases, actions_frame(spark))
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["rank"] for r in out.collect()) == [1] * 3 + [2] * 3 + [3] * 3
