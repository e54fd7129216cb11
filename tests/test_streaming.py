"""Stream state against the batch sweep."""

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.operators import velocity as V
from tidewatch.streaming import batches as B, state as S

SF = "/root/testdata/sf0.001"


def staged(spark, path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    for lo, hi in (("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01")):
        t = F.col("ts")
        e.filter((t >= F.lit(lo).cast("timestamp_ntz")) & (t < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(path)
    return path


def test_state_equals_batch(spark, tmp_path):
    stream = B.event_stream(spark, staged(spark, str(tmp_path / "in")), files_per_batch=1)
    out = B.run_available(S.entity_features(stream), "features", str(tmp_path / "out"))
    names = C.velocity_feature_names() + C.prior_feature_names()
    show = lambda d: d.select("transaction_id", *[F.round(n, 9).alias(n) for n in names])
    got = show(S.widen(spark.read.parquet(out)))
    want = show(V.velocity_features(B.events_to_txn(spark.read.parquet(f"{SF}/events.parquet"))))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ledger_is_chained_across_batches_and_replays_cleanly(spark, tmp_path):
    from tidewatch.operators import audit
    from tidewatch.sources import adapters as A

    txn = A.events_to_txn(spark.read.parquet(f"{SF}/events.parquet"))
    rec = audit.from_decisions(A.decisions(txn))
    root = str(tmp_path / "ledger")
    half = rec.agg(F.max("seq")).first()[0] // 2
    for batch, part in ((0, rec.filter(F.col("seq") <= half)), (1, rec.filter(F.col("seq") > half)), (1, rec.filter(F.col("seq") > half))):
        B.append_ledger(spark, part, root, batch)
    led = spark.read.parquet(root).drop("batch")
    assert audit.verify(led).first()["valid"] and led.count() == rec.count()


def test_a_batch_reads_the_heads_and_not_the_ledger(spark, tmp_path):
    from tidewatch.operators import audit

    rec = spark.range(30).selectExpr("id AS seq", "cast(id AS string) AS id", "'x' AS event_type", "'{}' AS payload")
    root = str(tmp_path / "ledger")
    for batch in range(3):
        B.append_ledger(spark, rec.filter(f"seq div 10 = {batch}"), root, batch)
    B.append_ledger(spark, rec.limit(0), root, 3)
    heads = {r["batch"]: r["seq"] for r in spark.read.parquet(f"{root}-heads").collect()}
    assert heads == {0: 9, 1: 19, 2: 29}
    assert audit.verify(spark.read.parquet(root).drop("batch")).first()["valid"]


def test_links_across_groups_of_blocks(spark, monkeypatch):
    from tidewatch.operators import audit

    monkeypatch.setattr(audit, "LINK_SLICE", 3)
    rec = spark.range(100).filter("id NOT BETWEEN 40 AND 61").selectExpr(
        "id AS seq", "cast(id AS string) AS id", "'x' AS event_type", "'{}' AS payload")
    chained = audit.chain(rec)
    rows = chained.orderBy("seq").collect()
    assert [r["prev_hash"] for r in rows] == [C.GENESIS, *[r["hash"] for r in rows[:-1]]]
    good = audit.verify(chained).first()
    assert (good["valid"], good["records"], good["first_broken_seq"], good["first_broken_index"]) == (True, 78, None, None)
    bad = audit.verify(chained.withColumn("payload", F.when(F.col("seq").isin(65, 80), "{1}").otherwise(F.col("payload")))).first()
    assert (bad["valid"], bad["first_broken_seq"], bad["first_broken_index"]) == (False, 65, 43)
    assert audit.verify(chained.limit(0)).first()["records"] == 0


def test_feedback_after_200_days_is_an_episode_and_the_rest_is_unmatched(spark, tmp_path):
    dec = spark.sql("""SELECT * FROM VALUES ('a', timestamp'2024-01-01', 'allow'), ('a', timestamp'2024-01-02', 'hold'),
                       ('b', timestamp'2024-01-01', 'hold') v(transaction_id, event_time, action)""")
    fb = spark.sql("""SELECT * FROM VALUES ('a', timestamp'2024-07-19', 'fraud'), ('z', timestamp'2024-01-02', 'legit'),
                      (NULL, timestamp'2024-01-02', 'legit'), ('b', timestamp'2023-12-31', 'legit') v(transaction_id, feedback_time, outcome)""")
    good, lost = str(tmp_path / "good"), str(tmp_path / "lost")
    for _ in range(2):  # a replay leaves the same
        B.match_feedback(spark, fb, dec, good, lost, 0)
    assert sorted((r["transaction_id"], r["action"], r["outcome"]) for r in spark.read.parquet(good).collect()) == [
        ("a", "allow", "fraud"), ("b", "hold", "legit")]
    assert sorted((r["transaction_id"] or "", r["error"]) for r in spark.read.parquet(lost).collect()) == [
        ("", "no audited decision for transaction ''"), ("z", "no audited decision for transaction 'z'")]


def test_rows_pass_once_however_old(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES ('a', timestamp'2024-01-01'), ('b', timestamp'2024-09-01'), ('c', NULL), (NULL, NULL)
                        v(id, event_time)""")
    root = str(tmp_path / "once")
    B.append_once(spark, rows.limit(0), root, 0, "id")
    B.append_once(spark, rows.unionByName(rows), root, 1, "id")
    B.append_once(spark, rows, root, 2, "id")  # a late repetition
    B.append_once(spark, rows, root, 2, "id")
    got = [r["id"] for r in B.read_batches(spark, root, schema=rows.withColumn("day", F.to_date("event_time")).schema).collect()]
    assert sorted(i for i in got if i) == ["a", "b", "c"] and got.count(None) == 3


def arrivals(spark, path, batches):
    """One file a batch of (id, minute-fraction us, user, value, merchant number)."""
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, us, user, value, f'{{"k":{m}}}') for i, us, user, value, m in rows], "i long, us long, u long, v double, p string").selectExpr(
            "i AS event_id", "cast(timestamp_micros(us) AS timestamp_ntz) AS ts", "u AS user_id", "'purchase' AS event_type", "v AS value", "p AS props").coalesce(1).write.parquet(f"{path}/part{n:03d}")
    return f"{path}/*"


def plain_windows(batches, ident):
    """Per event: count, sum and distinct merchants of each window, by a loop over what arrived before."""
    past, out = {}, {}
    for rows in batches:
        new = sorted((r for r in rows if ident(r) is not None), key=lambda r: (r[1], r[0]))
        for r in new:
            seen = past.setdefault(ident(r), [])
            for label, span in (("1h", 3600), ("24h", 86400), ("7d", 604800)):
                inside = [x for x in seen if r[1] - span * 1_000_000 <= x[1] <= r[1]]
                out[str(r[0]), label] = len(inside), round(sum(x[3] for x in inside), 4), len({x[4] for x in inside})
            seen.append(r)
    return out


def test_no_state_value_grows_with_its_entity(spark, tmp_path):
    """One customer has nine rows of ten over many batches, late ones among them."""
    import random

    rnd, t0, batches, i = random.Random(3), 1_704_067_200_000_000, [], 0
    for b in range(12):
        rows = []
        for _ in range(60):
            i += 1
            late = rnd.random() < 0.05 and b > 2
            us = t0 + b * 20_000_000_000 + rnd.randrange(0, 90_000_000) - (rnd.randrange(1, 40_000_000_000) if late else 0)
            rows.append((i, us, 7 if rnd.random() < 0.9 else rnd.randrange(20, 24), float(rnd.randrange(1, 50)), rnd.randrange(0, 12)))
        batches.append(rows)
    src = arrivals(spark, str(tmp_path / "in"), batches)
    out = B.run_available(S.entity_features(B.event_stream(spark, src, files_per_batch=1), rows=8), "hot", str(tmp_path / "out"))
    got = {r.transaction_id: r for r in spark.read.parquet(out).filter("ent = 'cust'").collect()}
    want = plain_windows(batches, lambda r: r[2])
    distinct = {w.label for w in C.CATALOGUE[0].windows if w.distinct}
    for (tid, label), (n, a, d) in want.items():
        r = got[tid]
        assert (r[f"n_{label}"], r[f"a_{label}"] / C.MONEY_SCALE, r[f"d_{label}"]) == (n, a, d if label in distinct else 0), (tid, label)

    def variable(name):
        return spark.read.format("statestore").option("path", f"{out}-checkpoint").option("stateVarName", name).load()

    assert variable("head").agg(F.max(F.size("value.at"))).first()[0] <= 8
    chunks = variable("chunks").filter("key.ent = 'cust' AND key.eid = '7'")
    assert chunks.count() > 50 and chunks.agg(F.max(F.size("user_map_value.at"))).first()[0] <= 8
    known, events = S.read_state(spark, f"{out}-checkpoint")
    assert known.filter("ent = 'cust'").agg(F.sum("n")).first()[0] == 720
    assert events.filter("ent = 'cust' AND eid = '7'").count() == sum(r[2] == 7 for rows in batches for r in rows)


def test_old_minutes_go_and_timers_empty_silent_entities(spark, tmp_path):
    day, t0 = 86_400_000_000, 1_704_067_200_000_000
    batches = [[(n * 100 + i, t0 + n * day + i * 1_000_000, 1 if n < 3 else 2, 1.0, i % 3) for i in range(20)] for n in range(12)]
    src = arrivals(spark, str(tmp_path / "in"), batches)
    for lateness, left in ((None, 60), ("1 hour", 0)):
        path = str(tmp_path / f"out-{left}")
        out = B.run_available(S.entity_features(B.event_stream(spark, src, files_per_batch=1), rows=8, lateness=lateness), "idle", path)
        known, events = S.read_state(spark, f"{out}-checkpoint")
        held = {r.eid: r["count"] for r in events.filter("ent = 'cust'").groupBy("eid").count().collect()}
        assert held.get("1", 0) == left  # silent since the third day
        assert 140 <= held["2"] <= 160  # eight of its nine days
        assert {r.eid: r.n for r in known.filter("ent = 'cust'").collect()} == {"1": 60, "2": 180}


def test_history_is_read_by_day(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id AS string) AS transaction_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS event_time", "id AS seq",
                                      "'c' AS customer_id", "'k' AS card_id", "'m' AS merchant_id", "cast(NULL AS string) AS device_id", "1.0D AS amount")
    root = str(tmp_path / "hist")
    B.append_history(rows.filter("seq < 30"), root, 0)
    new = rows.filter("seq >= 30")
    seen = B.recent_history(B.read_batches(spark, root, before=1), new)
    assert seen.count() == 7 and "day" in seen._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:300]
    assert B.sweep_batch(B.read_batches(spark, root, before=1), new).filter("transaction_id = '30'").first()["cust_v_7d_count"] == 7.0


def test_progress_has_a_row_for_every_batch_across_a_restart(spark, tmp_path):
    src, root, out = str(tmp_path / "in"), str(tmp_path / "progress"), str(tmp_path / "out")
    make = lambda lo, hi: spark.range(lo, hi, 1, hi - lo).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'purchase' AS event_type",
                                                                     "1.0D AS value", "'{}' AS props").write.mode("append").parquet(src)
    for lo, hi in ((0, 110), (110, 150)):  # stopped in between; more batches than a query's own progress keeps
        make(lo, hi)
        B.run_observed(B.event_stream(spark, src, files_per_batch=1).select("transaction_id"), "seen", root, [F.count(F.lit(1)).alias("rows")], path=out)
    p = spark.read.parquet(root).filter("rows > 0")
    assert p.count() == 150 and p.agg(F.sum("rows"), F.count_distinct("run")).first()[:] == (150, 2)
    assert spark.read.parquet(out).count() == 150


def test_groups_of_entities_leave_the_same_rows_and_state_as_single_ones(spark, tmp_path):
    src = arrivals(spark, str(tmp_path / "in"), [
        [(b * 400 + i, 1_704_067_200_000_000 + b * 40_000_000_000 + (i * 7919) % 40_000 * 1_000_000, i % 9, float(i % 13), i % 5) for i in range(400)] for b in range(3)])
    left = {}
    for parts in (None, 2):
        out = B.run_available(S.entity_features(B.event_stream(spark, src, files_per_batch=1), rows=8, parts=parts), "x", str(tmp_path / f"out-{parts}"))
        known, events = S.read_state(spark, f"{out}-checkpoint")
        left[parts] = [sorted(map(str, d.select(sorted(d.columns)).collect())) for d in (spark.read.parquet(out), known, events)]
    assert left[None] == left[2] and all(left[2])


def test_one_call_serves_many_entities(spark, tmp_path, monkeypatch):
    """The number of calls follows the groups and not the entities."""
    marks = str(tmp_path / "calls")
    old = S.EntityWindows.handleInputRows

    def counted(self, key, rows, timer):
        with open(marks, "a") as f:
            f.write("x")
        yield from old(self, key, rows, timer)

    class Counted(S.EntityWindows):
        handleInputRows = counted  # noqa: N815

    monkeypatch.setattr(S, "EntityWindows", Counted)
    src = arrivals(spark, str(tmp_path / "in"), [[(i, 1_704_067_200_000_000 + i * 1_000_000, i, 1.0, 1) for i in range(300)]])
    B.run_available(S.entity_features(B.event_stream(spark, src), C.CATALOGUE[:1], parts=4), "x", str(tmp_path / "out"))
    assert len(open(marks).read()) == 4


def test_lateness_keeps_what_a_late_event_can_read(spark, tmp_path):
    """An event an hour behind the newest one still reads its whole week."""
    day, hour, t0 = 86_400_000_000, 3_600_000_000, 1_704_067_200_000_000
    batches = [[(1, t0, 1, 1.0, 1), (2, t0 + 7 * day + hour // 2, 1, 1.0, 1)], [(3, t0 + 7 * day - 1_000_000, 1, 1.0, 1)]]
    for parts in (None, 4):
        src = arrivals(spark, str(tmp_path / f"in-{parts}"), batches)
        out = B.run_available(S.entity_features(B.event_stream(spark, src, files_per_batch=1), lateness="1 hour", parts=parts), "late", str(tmp_path / f"out-{parts}"))
        assert spark.read.parquet(out).filter("ent = 'cust' AND transaction_id = '3'").first()["n_7d"] == 1


class _State(dict):
    """A state map that counts its writes; under the empty key, a state value."""

    writes = 0

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    def exists(self):
        return () in self

    def update(self, value):
        self[()] = value

    def get(self, key=()):
        return super().get(key)


def test_heads_of_a_group_are_written_page_by_page():
    import numpy as np

    state, count = _State(), _State()
    head = lambda i: (i, 2 * i, None if i % 2 else 5, 7, i % 3 == 0, None, np.arange(i % 9), np.arange(i % 9) * 3, ["", "m"] * (i % 9))
    for rows in (range(50), range(50, 4000)):
        pages = S.Pages(state, count)
        for i in rows:
            pages.put(f"é{i}", head(i))
        pages.write()
    assert state.writes < 12 and len(state) == count[()][0] > 1  # 4,000 heads
    stored = S.Pages(state, count)
    found = dict(stored.items())
    plain = lambda v: [x.tolist() if isinstance(x, np.ndarray) else x for x in v]
    assert len(found) == 4000 and all(plain(found[f"é{i}"])[:8] == plain(head(i))[:8] for i in range(4000))
    for v in stored.loaded.values():
        assert sum(1 + len(x[6]) for x in v.values()) <= S.PAGE_ROWS


def test_rows_of_a_group_are_packed():
    import pyarrow as pa

    rows = [("cust", i % 4, f"e{i % 8}", str(i), i, i * 10, i, "m") for i in range(1000)] + [("card", 1, "e", "x", 1, 1, 1, "")]
    names = ["ent", "part", "eid", "transaction_id", "seq", "at", "amt", "merch"]
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    packs = [(r["ent"], r["part"], pa.ipc.read_record_batch(pa.py_buffer(r["pack"]), S._PACKED).to_pylist())
             for b in S.pack_rows(iter([batch.slice(0, 0), batch.slice(0, 600), batch.slice(600)])) for r in b.to_pylist()]
    assert len(packs) == 5
    assert sorted((e, p, *r.values()) for e, p, many in packs for r in many) == sorted(rows)


def test_priors_alone_keep_no_windows(spark, tmp_path):
    """Entities without windows have the same priors as with them, and heads of the newest instant only."""
    from tidewatch.plans.streams import PRIORS_ALONE

    stream = B.event_stream(spark, staged(spark, str(tmp_path / "in")), files_per_batch=1)
    out = B.run_available(S.entity_features(stream, PRIORS_ALONE, parts=8, cell_minutes=60), "priors", str(tmp_path / "out"))
    names = C.prior_feature_names()
    rows = spark.read.parquet(out)
    show = lambda d: d.select("transaction_id", *[F.round(n, 9).alias(n) for n in names])
    got, want = show(S.widen(rows, PRIORS_ALONE)), show(V.velocity_features(B.events_to_txn(spark.read.parquet(f"{SF}/events.parquet"))))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert rows.agg(F.max("kept")).first()[0] < 3 and "n_7d" not in rows.columns


def test_events_without_the_entity_stay(spark, tmp_path):
    """A stream that serves devices alone gives nothing for events without one; the query still has them, with nulls."""
    import __spark_entry__ as entry

    txn = B.events_to_txn(spark.read.parquet(f"{SF}/events.parquet"))
    got = entry.queries()["st_missing_entity"](spark, SF)
    without = txn.filter("device_id IS NULL").select("transaction_id")
    assert got.count() == txn.count() and without.count() > 0
    assert got.join(without, "transaction_id").filter("device_v_24h_count IS NULL AND device_v_7d_amount IS NULL").count() == without.count()
