"""Core operators against brute force and on the cases their docstrings define."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import alignment as A
from paperloom.operators import chunking as C
from paperloom.operators import documents as D
from paperloom.operators import ownership as O
from paperloom.operators import pages as P
from paperloom.operators import quality as Q
from paperloom.operators import relations as R
from paperloom.operators import retrieval as V
from paperloom.operators.intervals import periods_and_gaps
from paperloom.sources import readers, sinks
from paperloom.streaming import jobs as J


def brute_periods(ranges, upper):
    pages = set()
    for s, e in ranges:
        if s is not None and e is not None and 1 <= s <= e:
            pages |= set(range(s, e + 1))
    out, top = [], max(pages | {upper or 0} | {0})
    run = lambda want, kind, top: [(kind, g[0], g[-1]) for k, g in ((k, [p for _, p in g]) for k, g in itertools.groupby(((p in want, p) for p in range(1, top + 1)), key=lambda x: x[0])) if k]
    out += run(pages, "period", top)
    first, last = (min(pages), max(pages)) if pages else (None, None)
    free = set(range(1, upper + 1)) - pages if upper is not None else {p for p in range(first, last + 1)} - pages if pages else set()
    return sorted(out + run(free, "gap", top))


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("block", [4, 4096])
def test_periods(spark, bounded, block):
    rnd = random.Random(5)
    cases = {f"c{i}": [(rnd.choice([None, 0, rnd.randint(1, 30)]) if rnd.random() < 0.15 else rnd.randint(1, 30), rnd.choice([None, rnd.randint(1, 40)]) if rnd.random() < 0.1 else rnd.randint(1, 40)) for _ in range(rnd.randint(0, 6))] for i in range(60)}
    cases["hot"] = [(rnd.randint(1, 500), rnd.randint(1, 500)) for _ in range(40)]
    upper = {c: rnd.randint(1, 35) for c in cases}
    rows = [(c, s, e, 9, "x") for c, rs in cases.items() for s, e in rs for _ in range(2)]
    df = spark.createDataFrame(rows, "id string, start int, end int, _pos int, kind string")
    bounds = spark.createDataFrame(list(upper.items()), "id string, upper int")
    got = periods_and_gaps(df, ["id"], "start", "end", bounds if bounded else None, block)
    assert got.columns == ["id", "kind", "start", "end"]
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], []).append((r["kind"], r["start"], r["end"]))
    want = {c: brute_periods(rs, upper[c] if bounded else None) for c, rs in cases.items()}
    assert {c: sorted(v) for c, v in found.items()} == {c: v for c, v in want.items() if v}


def test_periods_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 5, 6)], "id string, s int, e int")
    assert sorted((r["kind"], r["start"], r["end"]) for r in periods_and_gaps(df, ["id"], "s", "e").collect()) == [("gap", 3, 4), ("period", 1, 2), ("period", 5, 6)]
    assert periods_and_gaps(df.limit(0), ["id"], "s", "e").count() == 0


def test_islands_and_runs(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 2, 2, 3, 7, 8, None)], "f string, page int")
    runs = P.islands(df, ["f"])
    assert sorted((r["start"], r["end"], r["pages"]) for r in runs.collect()) == [(1, 3, 3), (7, 8, 2)]
    assert P.longest_run(runs, ["f"]).first()["start"] == 1
    assert P.span_text(runs, ["f"]).first()["phrase"] == "pp. 1–3, 7–8"


def test_boundary_windows():
    text = "A sentence of some length here. " * 400
    ws = C.windows(text, 1000, 100)
    assert all(0 < len(w) <= 1000 for w in ws)
    assert all(w.endswith(".") for w in ws)
    assert C.windows("", 10, 2) == [] and C.windows("  ", 10, 2) == []
    assert len(C.windows("x" * 25, 10, 2)) == 3


def test_semantic_chunks():
    page = "PRAYER FOR RELIEF\n" + "word " * 1000 + "\n\nNo | Name\n1 | Ann | x\n2 | Bob | y\n\nok"
    got = C.semantic_chunks(page)
    assert all(n <= 900 for *_, n in got)
    assert got[0][1] == "PRAYER FOR RELIEF"
    assert "1 | Ann | x" in got[-1][2] and "Ann: Bob" in got[-1][2]


@pytest.mark.parametrize("seed", range(8))
def test_assignment(seed):
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 5), rnd.randint(1, 5)
    w = {(i, j): rnd.randint(1, 50) for i in range(n) for j in range(m) if rnd.random() < 0.6}
    got = Q.heaviest_matching(w)
    assert len(got) == len({i for i, _ in got}) == len({j for _, j in got})
    k = max(n, m)
    best = max(sum(w.get((i, p[i]), 0) for i in range(n)) for p in itertools.permutations(range(k)))
    assert sum(w[x] for x in got) == best


def test_span_matching(spark):
    s = "case string, id string, type string, start int, end int"
    t = spark.createDataFrame([("k", "a", "x", 1, 4), ("k", "b", "y", 5, 6), ("k", "bad", "y", 9, 2)], s)
    p = spark.createDataFrame([("k", "p", "x", 1, 5), ("k", "q", "y", 6, 6)], s)
    got = {(r["true_id"], r["predicted_id"], r["overlap"], r["exact"]) for r in Q.matched_spans(t, p, "case").collect()}
    assert got == {("a", "p", 4, False), ("b", "q", 1, False)}


def test_party_collapse(spark):
    rows = [("f", 1, "Asha Rao", "R Rao"), ("f", 2, "Asha Raoo", None), ("f", 3, "Bimal Sen", None), ("f", 4, None, None)]
    df = spark.createDataFrame(rows, "f string, pos int, name string, guardian string")
    got = {r["pos"]: r["party"] for r in Q.collapsed_parties(df, "f", "pos", "name", "guardian", F.col("guardian").isNotNull().cast("int")).collect()}
    assert got == {1: 0, 3: 2, 4: 3}


def test_packing(spark):
    df = spark.createDataFrame([("f", i, [i, i + 1]) for i in range(5)], "f string, n int, pages array<int>")
    got = Q.packed_batches(df, "f", "n", "pages", 4).orderBy("n").collect()
    assert [r["batch"] for r in got] == [0, 0, 0, 1, 1]


def test_quote_alignment():
    hay = "the court held that consent once given cannot be withdrawn to the detriment of another and no more".split()
    assert A.covered("consent once given cannot be withdrawn".split(), hay) == (6, 4, 9)
    assert A.covered("consent once given cannot be so withdrawn to the detriment of another".split(), hay)[0] >= 10
    assert A.covered("nothing of this is there at all".split(), hay) is None
    assert A.covered([], hay) is None


def test_top_k_without_scope(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = V.top_k(df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), df, [], 3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    vec = {r["vec_id"]: r["embedding"] for r in df.collect()}
    for q in (0, 10, 20, 30):
        want = sorted(((-round(cos(vec[q], vec[i]), 6), i) for i in vec if i != q))[:3]
        assert [r["vec_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in want]


def test_hierarchy_cycle_and_orphan(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("p", "q"), ("q", "p")], "i string, p string")
    got = {r["i"]: r["path"] for r in R.hierarchy(df, "i", "p").collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "x": ["x"]}


def test_guards(spark):
    df = spark.range(5)
    assert readers.guarded_scan(df, 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        readers.guarded_scan(df, 4).collect()
    with pytest.raises(Exception, match="too large"):
        R.checked(df, F.col("id") < 3, "too large").collect()


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert val(T.date_keys(F.lit("on 3.4.2020, 12/11/99 and 5 May 2021; June 7, 2019; 40.1.2020"))) == ["1999-11-12", "2019-06-07", "2020-04-03", "2021-05-05"]
    assert val(T.annexure_marks(F.lit("see Annexure P-03 and ANNEXURE R/2"))) == ["P-3", "R-2"]
    assert val(T.percent_text(F.lit("0.9"))) == "90%" and val(T.percent_text(F.lit("91 %"))) == "91%" and val(T.percent_text(F.lit("x"))) is None
    assert val(T.closed_json(F.lit('{"a": [1, {"b": "x'))) == '{"a": [1, {"b": "x"}]}'
    assert val(T.clean_markup(F.lit("<p>a&amp;b</p><br>**c**"))) == "a&b\nc"
    assert val(T.safe_url(F.lit("https://u:p@h.example/x?y#z"))) == "https://h.example/x"
    assert val(T.plain_name(F.lit("Dr. Asha  Rao (AOR)"))) == "Asha Rao"
    assert val(T.scoped_id(F.lit("a"), F.lit(None))) is None


def test_label_passes(spark):
    df = spark.createDataFrame([("f", 1, "a", False), ("f", 2, None, False), ("f", 3, "a", False), ("f", 4, "b", True), ("f", 5, "a", False)], "f string, page int, label string, weak boolean")
    got = D.repaired_labels(df, [lambda m: D.bridged(m, "f", "page", "label"), lambda m: D.smoothed(m, "f", "page", "label")])
    assert [r["label"] for r in got.orderBy("page").collect()] == ["a"] * 5
    rec = D.reconciled(df.withColumn("proposed", F.lit("a")), "f", "page", "label", "proposed")
    assert [r["label"] for r in rec.orderBy("page").collect()] == ["a"] * 5


def test_pacing(spark):
    df = spark.createDataFrame([(0, "k", "2024-01-01 00:00:00"), (1, "k", "2024-01-01 00:00:01"), (2, "k", "2024-01-01 00:01:00")], "i int, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    slots = [r["slot"] for r in J.paced(df, "k", "ts", "i", 10).orderBy("i").collect()]
    assert [s - slots[0] for s in slots] == [0, 10, 60]
    waits = [r["wait"] for r in J.token_bucket(df, "k", "ts", "i", 6, 1).orderBy("i").collect()]
    assert waits == [0.0, 9.0, 0.0]
    e = df.withColumn("o", F.col("i") % 2)
    assert [r["granted"] for r in J.leases(e, "k", "o", "ts", 30, "i").orderBy("i").collect()] == [True, False, True]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    docs = readers.binary_documents(spark, f"file://{tmp_path}/in")
    pages = readers.pages_by(docs, lambda b: [{"page": i, "text": t} for i, t in enumerate(b.decode().split("\n"), 1)], "page int, text string", ["name"])
    assert sorted(tuple(r) for r in pages.collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    pinned = docs.select("name", F.sha2("content", 256).alias("sha256"))
    assert readers.verified(docs, pinned).count() == 1
    path = f"file://{tmp_path}/up"
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, p string"), ["k"], "v", "p")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 2, "a"), (None, 3, "a")], "k int, v int, p string"), ["k"], "v", "p")
    assert sorted((r["k"], r["v"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, 2, "a"), (2, 1, "b")]
    sinks.delete_rows(spark, path, "k = 2", "p")
    assert spark.read.parquet(path).count() == 1


def test_empty_tables(spark):
    e = spark.createDataFrame([], "f string, page int, label string, t string, x double, y double, w double, h double")
    assert P.islands(e, ["f"]).count() == 0
    assert C.text_windows(e, ["f"], "t").count() == 0
    assert A.visual_lines(e, "f", "page").count() == 0
    assert D.table_rows(e, ["f"], "t", ["a", "b"]).count() == 0
    assert D.printed_folios(e, ["f"], "t").count() == 0


def test_bound_chunks_by_brute_force(spark):
    lead = "that the appeal was filed late"
    texts = {"c1": f"x {lead}. The cause was illness y", "c2": f"{lead}.  The CAUSE was\na strike", "c3": "nothing here", "c4": f"{lead}. The cause was a strike, too", "c5": None}
    chunks = [("f", c, part, a, z, texts[c]) for c, part, a, z in (("c1", "A", 1, 1), ("c2", "B", 2, 3), ("c3", "C", 4, 4), ("c4", "D", 5, 5), ("c5", "E", 6, 6))] + [("g", "c2", "B", 2, 3, texts["c2"])]
    quotes = [(1, "f", "B", 9, f"{lead}. The cause was a strike"), (2, "f", "Z", 5, f"{lead}. The cause was a strike"), (3, "f", "Z", None, f"{lead}. The cause was illness"), (4, "f", "C", 4, f"{lead}. The cause was unknown"), (5, "f", "Z", 1, "elsewhere"), (6, "f", None, 1, " "), (7, "f", "Z", 9, lead), (8, "g", "Z", 9, f"{lead}. the cause"), (9, "f", "E", 6, None)]
    c = spark.createDataFrame(chunks, "filing string, chunk string, part string, a int, z int, t string")
    e = spark.createDataFrame(quotes, "i int, filing string, part string, page int, q string")
    fold = lambda s: " ".join(s.lower().split())
    want = set()
    for i, f, part, page, q in quotes:
        found = []
        for g, k, p2, a, z, t in chunks:
            holds = bool(q and q.strip() and t) and fold(q) in fold(t)
            if f == g and (holds or part == p2):
                found.append((3 if not holds else 0 if part == p2 else 1 if page is not None and a <= page <= z else 2, k))
        want |= {(i, min(found)[1], min(found)[0])} if found else set()
    got = {tuple(r) for r in A.bound_chunks(e, c, "filing", "part", "q", "page", "i", "chunk", "t", "a", "z").collect()}
    assert got == want and {(1, "c2", 0), (2, "c4", 1), (3, "c1", 2), (4, "c3", 3)} <= got


def _binding_tables(spark, path, chunks, parts, evidence):
    c = spark.createDataFrame(chunks, "record_id string, file_hash string, document_part string, page_start int, page_end int, chunk_text string")
    e = spark.createDataFrame(evidence, "evidence_id long, filing_id string, document_part string, page int, quote string")
    rest = {"check_id": "string", "status": "string", "confidence": "double", "slot_id": "string", "boxes_status": "string", "found_at": "timestamp_ntz"}
    e = e.withColumns({k: F.lit(None).cast(kind) for k, kind in rest.items()})
    for name, df in (("chunks", c), ("filing_parts", spark.createDataFrame(parts, "filing_id string, file_hash string")), ("finding_evidence", e)):
        df.write.parquet(f"{path}/{name}.parquet")


def test_evidence_binding_of_odd_rows_as_in_sql(spark, tmp_path):
    from run_check import compare, connect

    rnd = random.Random(7)
    words = ["The", "court", "was", "late\u00a0or", "a", "No.", "ACT", "x\u000by", "on", "\u0915\u0932"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(n))
    chunks = [(rnd.choice([f"c{i}", f"c{i}", "c1", None]), rnd.choice(["f", "g", "h", None]), rnd.choice(["A", "B", None]), rnd.choice([1, 2, None]), rnd.choice([2, 5, None]), text(rnd.choice([0, 1, 3, 20, 60]))) for i in range(150)]
    chunks += [("n", "f", "C", 1, 1, None), (None, "k", "A", 1, 1, "alone here"), *chunks[:20]]
    quotes = []
    for i in range(400):
        t = rnd.choice(chunks)[5] or "none"
        at = rnd.randrange(len(t) + 1)
        quotes.append((rnd.choice([i, i, i % 20, None]), rnd.choice(["p", "q", "r", None]), rnd.choice(["A", "B", "C", None]), rnd.choice([1, 3, 9, None]), rnd.choice([t[at : at + rnd.choice([2, 9, 30, 90, 200])].upper(), None, "", "\n", "x y"])))
    _binding_tables(spark, tmp_path, chunks, [("p", "f"), ("p", "g"), ("q", "g"), ("q", None), ("r", "k"), ("r", "gone"), (None, "f"), ("p", "f")], quotes)
    said, ok = compare(spark, connect(str(tmp_path)), "evidence_binding", str(tmp_path))
    assert ok, said


def test_evidence_binding_writes_less_than_four_times_its_input(spark, tmp_path):
    from paperloom import catalog

    rnd = random.Random(3)
    lead = [f"w{i}" for i in range(40)]
    texts = [" ".join([*lead, *(f"w{rnd.randrange(3000)}" for _ in range(400))]) for _ in range(1500)]
    chunks = [(f"c{i}", "0" * 64, "A", i, i, t) for i, t in enumerate(texts)]
    # every quote begins with words that all texts have
    quotes = [(i, "p", "B", -1, " ".join(t.split(" ")[20:60])) for i, t in enumerate(texts)]
    _binding_tables(spark, tmp_path, chunks, [("p", "0" * 64)], quotes)
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = catalog.QUERIES["evidence_binding"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(i, f"c{i}", 2) for i in range(len(texts))}
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p.is_file())
    assert sum(v for k, v in written().items() if k not in before) < 4 * size


def test_deep_json_and_hierarchy(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "x": 2}')], "i int, p string")
    assert {(r["path"], r["value"]) for r in D.flattened_json(df, ["i"], "p").collect()} == {("a.b.c.d.e", '{"f":1}'), ("x", "2")}
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(18)], "i string, p string").coalesce(1)
    assert R.hierarchy(chain, "i", "p").agg(F.max("level")).first()[0] == 17


def test_whole_tables_of_the_column_functions(spark, tmp_path):
    import hashlib
    import re

    from paperloom.plans import functions as P2

    texts = [None, "", "Aé\tB", "यह  एक\nपाठ है", "ТЕКСТ  Один", "தமிழ்  உரை"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r["doc_id"]: r["h"] for r in P2.whitespace_fold(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else md5(re.sub(r"[ \t\n]+", " ", t.lower()).strip()) for i, t in enumerate(texts)}
    cut = {r["doc_id"]: (r["head"], r["rest"]) for r in P2.byte_slices(spark, str(tmp_path)).collect()}
    assert cut == {i: (t[:3], md5(t[3:])) for i, t in enumerate(texts) if t is not None}
    assert P2.clean_markup(spark, str(tmp_path)).count() == 5


def brute_bucket(times, per_minute, burst):
    level, last, out = burst, None, []
    for t in times:
        now = t if last is None else max(t, last)
        level = min(burst, level + (0 if last is None else (now - last) * per_minute / 60))
        wait = 0.0 if level >= 1 else (1 - level) * 60 / per_minute
        level, last = level + wait * per_minute / 60 - 1, now + wait
        out.append(round(now + wait - t, 3))
    return out


def test_bucket_and_pacing_by_brute_force(spark):
    """Waits and slots as one request after the other gives them, over the slices' edges, for a hot key and a null one."""
    import datetime

    rnd = random.Random(11)
    t0 = datetime.datetime(2024, 1, 1)
    times = {"hot": sorted(rnd.choice([rnd.uniform(0, 9000), rnd.uniform(4000, 4300)]) for _ in range(300)), None: [5.0, 5.0, 5.0, 7300.0], "one": [0.0]}
    rows = [(k, t0 + datetime.timedelta(seconds=round(t, 3)), i) for k, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = {(r["k"], r["i"]): r["wait"] for r in J.token_bucket(df, "k", "ts", "i", 2.0, 4).collect()}
    for k, ts in times.items():
        for i, w in enumerate(brute_bucket([round(t, 3) for t in ts], 2.0, 4)):
            assert abs(got[k, i] - w) < 0.01
    slots = {(r["k"], r["i"]): r["slot"] for r in J.paced(df, "k", "ts", "i", 30.0).collect()}
    for k, ts in times.items():
        last = None
        for i, t in enumerate(ts):
            last = round(t, 3) if last is None else max(round(t, 3), last + 30.0)
            assert abs(slots[k, i] - t0.replace(tzinfo=datetime.timezone.utc).timestamp() - last) < 0.01
    assert J.token_bucket(df.limit(0), "k", "ts", "i", 2.0, 4).count() == 0


def test_hot_key_of_many_events(spark):
    """Half of the events have one key."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 86400).alias("ts"), "id")
    assert J.token_bucket(df, "k", "ts", "id", 600.0, 5).count() == n
    assert J.paced(df, "k", "ts", "id", 0.5).agg(F.max("slot") - F.min("slot")).first()[0] >= n / 4 - 1


def test_queue_state(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    sent = spark.createDataFrame([("a", at(0)), ("a", at(50)), ("b", at(10)), ("c", at(10)), (None, at(1)), ("d", at(100))], "message_id string, sent_at timestamp")
    did = spark.createDataFrame([("a", at(5), "receive", 100.0), ("a", at(6), "extend", 20.0), ("b", at(20), "receive", None), ("c", at(11), "delete", None), ("x", at(1), "delete", None), ("d", at(50), "delete", None)], "message_id string, at timestamp, action string, seconds double")
    got = {r["message_id"]: (r["hidden_until"] and r["hidden_until"] - at(0).replace(tzinfo=datetime.timezone.utc).timestamp(), r["visible"]) for r in J.queue_state(sent, did, "2024-01-01 00:00:40").collect()}
    assert got == {"a": (26.0, True), "b": (50.0, False), "d": (None, True)}


def test_refined_boundaries(spark):
    r = spark.createDataFrame([("f", "s1", 1, 10), ("f", "s2", 11, 14), (None, "s3", 1, 2)], "f string, s string, start int, end int")
    m = spark.createDataFrame([("f", 1, "P", 19), ("f", 3, "R", 20), ("f", 4, "P", 20), ("f", 6, "P", 20), ("f", 8, "P", 22), ("f", 9, "P", 21), ("f", 12, "P", 2)], "f string, page int, series string, number int")
    got = sorted((x["s"], x["piece"], x["start"], x["end"]) for x in O.refined_by_marks(r, m, "f", "s", "start", "end").collect())
    assert got == [("s1", 1, 1, 3), ("s1", 2, 4, 8), ("s1", 3, 9, 10), ("s2", 1, 11, 14), ("s3", 1, 1, 2)]
    c = spark.createDataFrame([("f", 1, 1, "cover", False), ("f", 2, 5, "index", False), ("f", 6, 8, "index", True), ("f", 9, 10, "brief", True), ("f", 11, 12, "brief", True), ("f", 14, 14, "x", True)], "f string, start int, end int, category string, supported boolean")
    got = sorted((x["s"], x["piece"], x["start"], x["end"]) for x in O.refined_by_openings(r, c, "f", "s").collect())
    # the index runs on over its two pieces; s2 isn't covered whole
    assert got == [("s1", 1, 1, 1), ("s1", 2, 2, 8), ("s1", 3, 9, 10), ("s2", 1, 11, 14), ("s3", 1, 1, 2)]
    assert O.refined_by_marks(r.limit(0), m, "f", "s", "start", "end").count() == 0


def test_reconciled_spreads_over_any_distance(spark):
    rows = [("f", p, "a" if p == 1 else "b", True, "a" if p > 1 else None) for p in range(1, 40)] + [("f", 40, "c", False, "a"), ("f", 41, "b", True, "a"), ("g", 1, None, False, "z"), ("g", 2, "b", True, "y")]
    df = spark.createDataFrame(rows, "f string, page int, label string, weak boolean, proposed string")
    got = {(r["f"], r["page"]): r["label"] for r in D.reconciled(df, "f", "page", "label", "proposed").collect()}
    assert all(got["f", p] == "a" for p in range(1, 40)) and got["f", 40] == "c" and got["f", 41] == "b" and got["g", 1] == "z" and got["g", 2] == "b"


def test_reranked_keeps_every_hit(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(1, 101)], "q int, i int, rank int")
    scores = spark.createDataFrame([(1, i, float(i)) for i in range(1, 101) if i % 2], "q int, i int, score double")
    got = {r["i"]: r["rerank"] for r in V.reranked(hits, scores, "q", "i").collect()}
    assert len(got) == 100 and got[59] == 1 and got[1] == 30 and got[2] == 31 and all(got[i] == i for i in range(61, 101))


def test_moved_keys_and_generations(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "b")], "k int, v int, p string"), ["k"], "v", "p")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 2, "b"), (None, 2, "a")], "k int, v int, p string"), ["k"], "v", "p")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "p").collect()) == [(1, 2, "b"), (2, 1, "b"), (3, 1, "b")]
    g = str(tmp_path / "g")
    for name in ("g1", "g2", "g3"):
        sinks.write_generation(spark.createDataFrame([(name,)], "x string"), g, name)
        assert [(r["x"], r["generation"]) for r in sinks.read_active(spark, g).collect()] == [(name, name)]
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.name.startswith("gen")) == ["generation=g3"]


def test_cluster_needs_a_shared_folder():
    from paperloom import session

    class Unset(dict):
        master = "spark://somewhere:7077"

    class Session:
        conf = Unset()
        sparkContext = Unset()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
