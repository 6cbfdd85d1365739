from glyphlake.sources import readers


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_readers(spark, tmp_path):
    m = readers.merges(spark, put(tmp_path / "m", "#version: 0.2\na b\nc d\na b\n"))
    assert [tuple(r) for r in m.orderBy("rank").collect()] == [(0, "a", "b"), (1, "c", "d")]
    a = readers.arcs(spark, put(tmp_path / "a", "0 0 2 3 1.5\n0 0 1 1\n0\n"))
    assert sorted(r["cost"] for r in a.collect()) == [0.0, 1.5]
    t = readers.int_transcripts(spark, put(tmp_path / "t", "u1 3 1\nu2\n"))
    assert {r["utt_id"]: r["syms"] for r in t.collect()} == {"u1": [3, 1], "u2": []}
    s = readers.symbols(spark, put(tmp_path / "s", "a 2\nb 3\n"))
    rows = spark.createDataFrame([("u", ["b", "a"]), ("v", [])], "utt_id string, syms array<string>")
    assert {r["utt_id"]: r["syms"] for r in readers.encode(rows, s).collect()} == {"u": [3, 2], "v": []}
    j = readers.json_text(spark, put(tmp_path / "j", '{"text": "a\\\\nb"}\n'))
    assert sorted(r["line"] for r in j.collect()) == ["a", "b"]


def test_json_text_keeps_the_order(spark, tmp_path):
    for k in range(2):
        put(tmp_path / f"f{k}.json", "".join(f'{{"text": "same"}}\n{{"text": "r{k}{i}"}}\n' for i in range(5)))
    got = [r["line"] for r in readers.json_text(spark, f"file://{tmp_path}/*.json").orderBy("doc_id", "line_no").collect()]
    assert got == [x for k in range(2) for i in range(5) for x in ("same", f"r{k}{i}")]


def test_graph_archives(spark, tmp_path):
    path = put(tmp_path / "a", "u1\n0 1 2 3 0.5\n1 2 4 4\n2\n\nu2\n0 1 0 7 1\n1 0.25\n\n")
    first = {r["utt_id"]: (sorted(map(tuple, r["arcs"])), [tuple(x) for x in r["finals"]]) for r in readers.graph_archive(spark, path).collect()}
    assert first == {"u1": ([(0, 1, 2, 3, 0.5), (1, 2, 4, 4, 0.0)], [(2, 0.0)]), "u2": ([(0, 1, 0, 7, 1.0)], [(1, 0.25)])}
    readers.write_graph_archive(readers.graph_archive(spark, path), f"file://{tmp_path}/out")
    again = {r["utt_id"]: (sorted(map(tuple, r["arcs"])), [tuple(x) for x in r["finals"]]) for r in readers.graph_archive(spark, f"file://{tmp_path}/out").collect()}
    assert again == first


def test_small_readers_and_sinks(spark, tmp_path):
    assert [r["line"] for r in readers.text_lines(spark, put(tmp_path / "l", "  a b \n")).collect()] == ["a b"]
    assert [tuple(r) for r in readers.vocabulary(spark, put(tmp_path / "v", "a 3\nb 1\n"), 2).collect()] == [("a", 3)]
    x = readers.lexicon(spark, put(tmp_path / "x", "é 1.0 p q\n")).first()
    assert (x["word"], x["phones"]) == ("é", ["p", "q"])
    (tmp_path / "w").mkdir()
    for n in ("r1.wav", "r2.wav", "no.txt"):
        (tmp_path / "w" / n).write_bytes(b"RIFF")
    files = readers.recordings(spark, f"file://{tmp_path}/w")
    assert {r["utt_id"] for r in files.collect()} == {"r1", "r2"}
    cut = readers.segments(spark, put(tmp_path / "s", "u1 r1 0 2.5\nu2 r1 2.5 9\nu3 r9 0 1\nu4 r1 8 9\n"))
    long = spark.createDataFrame([("r1", 4.0), ("r2", 1.0)], "utt_id string, dur double")
    assert sorted((r["utt_id"], r["start"], r["end"]) for r in readers.segmented(files, cut, long).collect()) == [("u1", 0.0, 2.5), ("u2", 2.5, 4.0)]
    assert readers.segmented(files, None).count() == 2
    assert [r["dur"] for r in readers.durations(spark.createDataFrame([("u", 123)], "utt_id string, num_frames int")).collect()] == [2.46]
    readers.write_arcs(spark.createDataFrame([(0, 1, 2, 3, 0.0)], "src int, dst int, isym int, osym int, cost double"), f"file://{tmp_path}/m")
    assert [tuple(r) for r in readers.arcs(spark, f"file://{tmp_path}/m").collect()] == [(0, 1, 2, 3, 0.0)]
    both = readers.combined([spark.createDataFrame([(2,), (1,)], "k int"), spark.createDataFrame([(0,)], "k int")], ["k"])
    assert [r["k"] for r in both.collect()] == [1, 2, 0]
    slots = readers.posteriors(spark, put(tmp_path / "p", "u 0 5 0.25\nu 0 4 0.75\nu 1 0 1.0\n")).first()["slots"]
    assert [[a["sym"] for a in s] for s in slots] == [[4, 5], [0]]


def test_hypotheses_without_result(spark, tmp_path):
    found = spark.createDataFrame([("a", [1, 2], 0.5)], "utt_id string, tokens array<int>, cost double")
    every = spark.createDataFrame([("a",), ("b",)], "utt_id string")
    for utterances, n in ((None, 1), (every, 2)):
        readers.write_hypotheses(found, f"file://{tmp_path}/h", utterances)
        rows = {r["utt_id"]: r["tokens"] for r in spark.read.parquet(f"file://{tmp_path}/h").collect()}
        assert len(rows) == n and rows.get("b", []) == []


def test_stages_resume(spark, tmp_path):
    from glyphlake.plans import stages

    made = []

    def stage(name, f):
        return name, lambda done: (made.append(name), f(done))[1]

    plan = [stage("one", lambda d: spark.range(3)), stage("two", lambda d: d["one"].selectExpr("id * 2 as id"))]
    for first, want in ((None, ["one", "two"]), (None, []), ("two", ["two"])):
        made.clear()
        out = stages.run(spark, plan, f"file://{tmp_path}/run", first)
        assert made == want and sorted(r["id"] for r in out["two"].collect()) == [0, 2, 4]
