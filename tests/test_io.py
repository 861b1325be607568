import json
import os

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import running
from vigilframe.sources import graphs, json_documents, readers, writers


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_json_documents(spark, folder):
    put(folder, "a.json", json.dumps([{"host": "h1", "n": {"x": 1}, "z": None}, {"src_ip": "1.1.1.1"}]))
    put(folder, "b.json", '{"device": "d9", "ok": true}')
    put(folder, "c.json", "{not json")
    rows = readers.read_json_events(spark, folder).collect()
    got = {(r["source"], r["asset_id"]) for r in rows}
    assert got == {("a.json", "h1"), ("a.json", "1.1.1.1"), ("b.json", "d9"), ("c.json", "")}
    first = next(r["raw"] for r in rows if r["asset_id"] == "h1")
    assert first == {"host": "h1", "n": '{"x":1}', "z": ""}
    assert next(r["raw"] for r in rows if r["source"] == "c.json") == {"message": "{not json", "parse_error": "invalid_json"}


def _awkward_events(n):
    texts = ['"}{][', "\\", 'a\\"}', "}\n}", "", "é}\u2028{", '\\\\"', "[{}]"]
    return [{"host": f"h{i}", "t": texts[i % len(texts)] * (i % 3), "n": {"a": [{"b": texts[i % 7]}, []], "e": {}}, "z": None} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_large_json_document_is_read_by_many_tasks(spark, folder, monkeypatch, indent):
    events = _awkward_events(60)
    path = put(folder, "big.json", " " + json.dumps(events, indent=indent, ensure_ascii=False) + "\n")
    expected = [r.asDict() for r in readers.read_json_events(spark, path).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    monkeypatch.setattr(running, "RANGE_ROWS", 100)
    try:
        assert json_documents._pieces(spark, path).rdd.getNumPartitions() > 5
        elements = json_documents.document_elements(spark, path).orderBy("position").collect()
        got = [r.asDict() for r in json_documents.read_json_documents(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["position"] for r in elements] == list(range(60)) and all(r["whole"] for r in elements)
    assert [json.loads(r["value"]) for r in elements] == events
    key = lambda r: r["asset_id"]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_json_documents_that_break_off_or_are_no_arrays(spark, folder):
    put(folder, "cut.json", '[{"a": 1}, {"b": "}"}, {"c": ')
    put(folder, "cut2.json", '[{"a": 1}, {"b": {"c": 2}')
    put(folder, "comma.json", '[{"a": 1},')
    put(folder, "bad.json", '[{"a": }, {"b": 2}]')
    put(folder, "one.json", ' {"a": {"b": {}}, "l": [{}]}\n')
    put(folder, "tight.json", '{"a": 1}')
    put(folder, "empty.json", "")
    put(folder, "none.json", "[ ]\n")
    put(folder, "text.json", "no json")
    got = {}
    for r in json_documents.document_elements(spark, folder).orderBy("source", "position").collect():
        got.setdefault(r["source"], []).append((r["value"], r["whole"]))
    assert got == {
        "cut.json": [('{"a": 1}', True), ('{"b": "}"}', True), ('{"c":', False)],
        "cut2.json": [('{"a": 1}', True), ('{"b": {"c": 2}', False)],
        "comma.json": [('{"a": 1}', True), (",", False)],
        "bad.json": [('{"a": }', True), ('{"b": 2}', True)],
        "one.json": [('{"a": {"b": {}}, "l": [{}]}', True)],
        "tight.json": [('{"a": 1}', True)],
        "text.json": [("no json", False)],
    }
    marked = json_documents.read_json_documents(spark, folder).where("raw['parse_error'] is not null")
    assert sorted(r["source"] for r in marked.collect()) == ["bad.json", "comma.json", "cut.json", "cut2.json", "text.json"]


@pytest.mark.parametrize("chunk", [1, 100, 1 << 20])
def test_json_documents_do_not_depend_on_chunks_and_only_cut_elements_are_shuffled(spark, folder, monkeypatch, chunk):
    events = _awkward_events(60)
    put(folder, "a.json", json.dumps(events, ensure_ascii=False))
    put(folder, "b.json", "\n".join(json.dumps(e) for e in events) + '\n{"a": "}')
    put(folder, "junk.json", "} }")
    with open(os.path.join(folder, "bytes.json"), "wb") as fh:
        fh.write(b'[{"a": "\xff\\\xc3\xa9}"}, {"b": 1}]')
    monkeypatch.setattr(json_documents, "CHUNK", chunk)
    rows = json_documents.document_elements(spark, folder)
    got = {}
    for r in rows.orderBy("source", "position").collect():
        got.setdefault(r["source"], []).append(r)
    assert [json.loads(r["value"]) for r in got["a.json"]] == events and all(r["whole"] for r in got["a.json"])
    assert [json.loads(r["value"]) for r in got["b.json"][:60]] == events
    assert [r["position"] for r in got["b.json"]] == list(range(61)) and (got["b.json"][60]["value"], got["b.json"][60]["whole"]) == ('{"a": "}', False)
    assert [(r["position"], r["value"], r["whole"]) for r in got["junk.json"]] == [(None, "} }", None)]
    assert [r["value"] for r in got["bytes.json"]][1:] == ['{"b": 1}']
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_inner") == 1 and "Window" not in plan.split("_inner")[0]


def test_json_lines_keep_malformed(spark, folder):
    put(folder, "x.jsonl", '{"host": "a"}\n\nnope\n')
    rows = readers.read_json_lines(spark, folder).collect()
    assert sorted(r["asset_id"] for r in rows) == ["", "a"]


def test_csv_headers_and_text_lines(spark, folder):
    path = put(folder, "e.csv", " Src IP ,Bytes Sent\n1.1.1.1,12\n")
    df = readers.read_csv_events(spark, path)
    assert df.columns == ["src_ip", "bytes_sent"] and df.first()["bytes_sent"] == 12
    txt = put(folder, "e.txt", 'host=h1 msg="a b"\n  \njust one=pair\n')
    rows = readers.read_text_events(spark, txt).collect()
    assert {r["asset_id"] for r in rows} == {"h1", ""}
    assert {"message": "just one=pair"} in [r["raw"] for r in rows]


def test_flow_csv_keeps_blank_headers(spark, folder):
    path = put(folder, "f.csv", "Flow ID, Source IP, Label\n7,1.2.3.4,BENIGN\n")
    raw = readers.read_flow_csv(spark, path).first()["raw"]
    assert raw == {"Flow ID": "7", " Source IP": "1.2.3.4", " Label": "BENIGN"}


def test_dimension_files(spark, folder):
    assets = put(folder, "assets.json", json.dumps({"web": {"ip": "1.1.1.1", "criticality": "HIGH", "can_reboot": False}, "db": {"ip": "2.2.2.2"}}))
    got = {r["asset_id"]: r for r in readers.read_assets(spark, assets).collect()}
    assert got["web"]["can_reboot"] is False and got["db"]["criticality"] is None
    camps = put(folder, "c.json", json.dumps({"APT": {"ttp_sequence": ["T1", "T2"], "preventive_actions": {"T2": "block"}}}))
    row = readers.read_campaigns(spark, camps).first()
    assert row["name"] == "APT" and row["ttp_sequence"] == ["T1", "T2"] and row["preventive_actions"] == {"T2": "block"}
    ids = spark.read.text(put(folder, "w.json", '{"whitelisted_ips": ["a", "b", "a"]}'), wholetext=True)
    assert {r[0] for r in readers.id_list(ids, "whitelisted_ips", "ip").collect()} == {"a", "b"}
    corpus = put(folder, "k.json", json.dumps([{"name": "n", "ttp_chain": ["T1"], "trust_weight": 0.5}, {"title": "t"}]))
    from vigilframe.operators.attribution import corpus as union

    docs = union({"MITRE": readers.read_corpus_file(spark, corpus)}).collect()
    assert {(r["text"], r["trust_weight"], r["source"]) for r in docs} == {("n T1", 0.5, "MITRE"), ("t", 0.9, "MITRE")}


def test_graph_file(spark, folder):
    doc = {"nodes": [{"id": "a", "type": "t", "criticality": 0.5}, {"id": "b"}], "edges": [{"from": "a", "to": "b", "timestamps": ["2026-01-10T00:01:00Z", "bad"]}, {"from": "b", "to": "a", "weight": 0.9, "timestamps": []}]}
    nodes, edges = graphs.read_graph(spark, put(folder, "g.json", json.dumps(doc)))
    assert nodes.count() == 2
    assert {(r["src"], r["weight"], r["ordinal"]) for r in edges.collect()} == {("a", 0.5, 0), ("b", 0.9, 1)}
    t = graphs.temporal_edges(edges, F.lit("2026-01-10 00:00:00").cast("timestamp")).collect()
    assert [(r["src"], r["seconds"]) for r in t] == [("a", 60.0)]


def test_flow_directory_with_cap(spark, folder):
    put(folder, "a.csv", "Src IP,Dst IP,Label\n" + "".join(f"s{i},d{i},{'Benign' if i % 2 else 'DoS'}\n" for i in range(9)))
    put(folder, "b.csv", "Src IP,Dst IP,Label\ns0,,Benign\nx,y,0\n")
    nodes, edges = graphs.read_flow_directory(spark, folder, "APT_FLOW", "D", limit_per_file=4)
    rows = edges.orderBy("src").collect()
    assert len(rows) == 5 and [r["label"] for r in rows] == [1, 0, 1, 0, 0]
    assert nodes.count() == 10


def test_stix_file(spark, folder):
    objs = [
        {"type": "attack-pattern", "id": "t1", "name": "N", "external_references": [{"source_name": "mitre-attack", "external_id": "T1595"}]},
        {"type": "intrusion-set", "id": "g1"}, {"type": "x-mitre-tactic", "id": "late"}, {"type": "malware", "id": "m1", "description": "d" * 300}, {"type": "note", "id": "n1"},
        {"type": "relationship", "source_ref": "g1", "target_ref": "t1", "relationship_type": "uses-it"}, {"type": "relationship", "source_ref": "g1", "target_ref": "late"},
    ]
    nodes, edges = graphs.read_stix(spark, put(folder, "s.json", json.dumps({"objects": objs})), limit=2)
    got = {r["id"]: r for r in nodes.collect()}
    assert set(got) == {"t1", "g1", "m1"} and got["t1"]["mitre_id"] == "T1595" and len(got["m1"]["description"]) == 300 and got["g1"]["name"] == "g1"
    assert [(r["src"], r["dst"], r["relation"]) for r in edges.collect()] == [("g1", "t1", "USES_IT")]
    nodes, edges = graphs.read_stix(spark, folder + "/s.json")  # by default nothing is left out
    assert nodes.count() == 4 and edges.count() == 2


def test_lines_and_sensors(spark):
    lines = spark.createDataFrame([("5,u@d,C1,C2",), ("short,line",), ("",), ("6,u@d,C1,C3,extra",)], "value string")
    nodes, edges = graphs.lateral_movement(lines)
    assert edges.count() == 4 and {r["id"] for r in nodes.collect()} == {"u@d", "C1", "C2", "C3"}
    wide = spark.createDataFrame([(1, "1.5", "x", "2"), (2, None, None, "3")], "i int, a string, b string, c string")
    _, chain = graphs.sensor_chain(wide, "i", ["a", "b", "c"], F.lit(0))
    assert [(r["row_id"], r["src"], r["dst"], r["value"]) for r in chain.collect()] == [(1, "sensor_a", "sensor_c", 2.0)]


def test_zip_by_position(spark, folder):
    a, b = os.path.join(folder, "a"), os.path.join(folder, "b")
    spark.range(1000).repartition(4).write.parquet(a)
    left = spark.read.parquet(a)
    numbered = left.withColumn("proto", F.lit("tcp")).withColumn("sbytes", F.lit("3")).withColumn("dbytes", F.lit("4"))
    out = graphs.training_flows(numbered, left.select((F.col("id") * 2).alias("label")))
    assert out.count() == 1000 and out.where("label <> id * 2 OR bytes <> 7 OR protocol <> 6").count() == 0
    benign, attack = graphs.benign_split(spark.createDataFrame([(" benign ",), ("DoS",), (None,)], "l string"), "l")
    assert (benign.count(), attack.count()) == (1, 2)


def test_zip_goes_by_file_name_not_by_size(spark, folder):
    for side, sizes in (("l", (2, 6)), ("r", (6, 2))):
        start = 0
        for name, n in zip("ab", sizes):
            spark.range(start, start + n).coalesce(1).write.parquet(os.path.join(folder, side, f"part={name}"))
            start += n
    left = spark.read.parquet(os.path.join(folder, "l")).select(F.col("id").alias("x"))
    right = spark.read.parquet(os.path.join(folder, "r")).select(F.col("id").alias("y"))
    assert sorted(map(tuple, graphs.zipped_by_position(left, right).collect())) == [(i, i) for i in range(8)]


def test_log_sink_prunes_days(spark, folder):
    df = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, None)], "id int, s string").select("id", F.col("s").cast("timestamp").alias("at"))
    writers.append_log(df, folder + "/log", F.lit("2024-02-02").cast("timestamp"))
    back = spark.read.parquet(folder + "/log")
    assert back.where("dt = DATE '2024-02-02'").first()["id"] == 2
    plan = back.where("dt = DATE '2024-02-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_report_files(spark, folder):
    stats = spark.createDataFrame([("total", "all", 4), ("type", "DDoS", 3), ("type", "<x>", 1), ("sector", "s", 4)], "dimension string, item string, incidents bigint")
    texts = writers.write_report(stats, folder, "Report & more", "2024")
    assert "| DDoS | 3 | 75.0% |" in texts["markdown"] and "&lt;x&gt;" in texts["html"]
    assert spark.read.json(folder + "/statistics").count() == 4 and "# Report" in spark.read.text(folder + "/markdown").first()[0]
    assert len(writers.report_entry(texts, spark).first()["content_hash"]) == 64


def test_missing_address_columns_fail(spark):
    with pytest.raises(ValueError):
        graphs.flow_table_edges(spark.range(1), "R", "S")
