import json
import os

import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.operators.encode import records
from kindred.plans.profiles import VALIDATE, Thresholds
from kindred.sources import audit, config, sinks, tables
from kindred.streaming import limits, matching

CSV = "id,first_name,dob,zip\n1,Ann,1985-01-02,12345\n2,Bob,,\n2,Bobby,1/2/85,99\n"


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv(spark, tmp_path):
    df = tables.csv(spark, write(tmp_path / "a.csv", CSV))
    rows = [tuple(r)[:4] for r in df.orderBy("_pos").collect()]
    assert rows == [("1", "Ann", "1985-01-02", "12345"), ("2", "Bobby", "1/2/85", "99"), ("2", "Bobby", "1/2/85", "99")]
    assert tables.get(df, "id", "1").count() == 1
    with pytest.raises(KeyError):
        tables.get(df, "id", "9")
    assert [r["id"] for r in tables.page(df, 1, 5).collect()] == ["2", "2"]
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            tables.page(df, bad, 1)
    assert tables.headers(df) == ["first_name", "dob", "zip"]
    with pytest.raises(Exception):
        tables.csv(spark, write(tmp_path / "bad.csv", "a,b\n1,2,3\n")).collect()
    with pytest.raises(ValueError):
        tables.csv(spark, write(tmp_path / "none.csv", "a,b\n"))


def test_truth_and_matches(spark, tmp_path):
    path = write(tmp_path / "truth.csv", "x,y\n 1 , a\n1,b\n,c\n")
    assert [tuple(r) for r in tables.ground_truth(spark, path).collect()] == [("1", "b")]
    m = spark.createDataFrame([("1", "b"), ("2", "c")], "id1 string, id2 string")
    lines = [r["line"] for r in sinks.match_lines(m, ["one", "two", "three"]).orderBy("n", "k").collect()]
    path = write(tmp_path / "matches.csv", "\n".join(lines) + "\n")
    assert sorted(map(tuple, tables.matches_file(spark, path).collect())) == [("1", "b"), ("2", "c")]
    path = write(tmp_path / "m.json", json.dumps({"matches": [{"local_id": "1", "peer_id": "b"}]}))
    assert [tuple(r) for r in tables.matches_file(spark, path).collect()] == [("1", "b")]
    with pytest.raises(ValueError):
        sinks.write_matches(m, str(tmp_path / "x"), "xml")


def test_token_files(spark, tmp_path):
    own = records(tables.csv(spark, write(tmp_path / "a.csv", CSV)).dropDuplicates(["id"]), ["first_name", "zip"], VALIDATE)
    rows = sinks.token_rows(own, VALIDATE, "t").persist()
    sinks.write_tokens(rows, str(tmp_path / "tokens.csv"))
    back = tables.last_tokens(tables.tokens_file(spark, str(tmp_path / "tokens.csv")))
    want = {r["id"]: (r["bits"], r["signature"]) for r in own.collect()}
    for recompute in (False, True):
        got = {r["id"]: (r["bits"], r["signature"]) for r in tables.token_records(back, recompute).collect()}
        assert got == want
    stats = tables.token_statistics(rows).first()
    assert stats["total_records"] == 2 and stats["has_timestamps"]
    path = write(tmp_path / "t.json", json.dumps([r.asDict() for r in rows.collect()]))
    assert tables.tokens_file(spark, path).count() == 2
    bad = rows.withColumn("bloom_filter", F.lit("!"))
    with pytest.raises(Exception):
        tables.token_records(bad).collect()
    assert tables.token_records(bad, strict=False).count() == 0
    key = sinks.new_key_hex()
    enc = str(tmp_path / "tokens.enc")
    sinks.write_encrypted(rows, enc, key)
    assert oct(os.stat(enc).st_mode & 0o777) == "0o600"
    assert {r["id"] for r in tables.encrypted_tokens(spark, enc, key).collect()} == set(want)
    with pytest.raises(Exception):
        tables.encrypted_tokens(spark, enc, "0" * 64).collect()
    sinks.save_key(str(tmp_path / "k.key"), key)
    assert sinks.load_key(str(tmp_path / "k.key")) == key
    sinks.secure_delete(enc)
    assert not os.path.exists(enc)


ODD = ["plain", "Doe, J", 'say "hi"', "two\nlines", "a\r\nb", "x,\"y\",\nz", " space ", "#1", "back\\slash", "é漢"]


@pytest.mark.parametrize("one", [100, 0])
def test_encrypted_files_keep_odd_ids(spark, tmp_path, one):
    rows = spark.createDataFrame([(x, f"b,{i}", f'm"{i}', "t") for i, x in enumerate(ODD)], "id string, bloom_filter string, minhash string, timestamp string")
    key, path = sinks.new_key_hex(), str(tmp_path / "odd.enc")
    sinks.write_encrypted(rows, path, key, most=3, one=one)
    assert tables.is_folder(spark, path) == (not one)
    assert sorted(map(tuple, tables.encrypted_tokens(spark, path, key).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception):
        tables.encrypted_tokens(spark, path, "1" * 64).collect()


def test_token_and_match_files_keep_odd_ids(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(x, f"b{i}", f"m{i}", "t") for i, x in enumerate(ODD)], "id string, bloom_filter string, minhash string, timestamp string")
    for name in ("t.csv", "t.json"):
        sinks.save_tokens(rows, str(tmp_path / name))
        assert sorted(r["id"] for r in tables.tokens_file(spark, str(tmp_path / name)).collect()) == sorted(ODD)
    ids = [x for x in ODD if "\n" not in x]
    m = spark.createDataFrame([(x, f"p{i},\"") for i, x in enumerate(ids)], "id1 string, id2 string")
    want = sorted(map(tuple, m.collect()))
    for kind in ("csv", "json"):
        sinks.write_matches(m, str(tmp_path / kind), kind)
        assert sorted(map(tuple, tables.matches_file(spark, str(tmp_path / kind)).collect())) == want
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 2)
    sinks.export(m, str(tmp_path / "many"), "json")
    assert sorted(map(tuple, tables.matches_file(spark, str(tmp_path / "many")).collect())) == want
    assert sum(r["count"] for r in spark.read.json(str(tmp_path / "many")).collect()) == len(ids)
    sinks.write_matches(m.limit(0), str(tmp_path / "none"), "json")
    assert tables.matches_file(spark, str(tmp_path / "none")).count() == 0 and spark.read.text(str(tmp_path / "none")).count() == 1
    plain = m.where("id1 not like '#%'")
    sinks.write_intersection(plain, str(tmp_path / "lines"))
    assert sorted(map(tuple, tables.matches_file(spark, str(tmp_path / "lines")).collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        sinks.export(m, str(tmp_path / "y"), "xml")
    indented = write(tmp_path / "i.json", json.dumps({"matches": [{"local_id": "1", "peer_id": "b"}], "count": 1}, indent=2))
    assert [tuple(r) for r in tables.matches_file(spark, indented).collect()] == [("1", "b")]


def test_loading_tokens_by_name_and_key(spark, tmp_path):
    own = records(tables.csv(spark, write(tmp_path / "a.csv", CSV)).dropDuplicates(["id"]), ["first_name", "zip"], VALIDATE)
    rows = sinks.token_rows(own, VALIDATE, "t").persist()
    want = {r["id"]: (r["bits"], r["signature"]) for r in own.collect()}
    key, path = sinks.new_key_hex(), str(tmp_path / "x.enc")
    sinks.write_encrypted(rows, path, key)
    sinks.save_key(str(tmp_path / "x.key"), key)
    sinks.save_key(str(tmp_path / "other.key"), "0" * 64)
    sinks.write_tokens(rows, str(tmp_path / "plain.csv"))
    for args in ((path, key, str(tmp_path / "other.key")), (path, "", str(tmp_path / "x.key")), (path,), (str(tmp_path / "plain.csv"),)):
        assert {r["id"]: (r["bits"], r["signature"]) for r in tables.load_tokens(spark, *args).collect()} == want
    with pytest.raises(Exception):
        tables.load_tokens(spark, path, "", str(tmp_path / "other.key")).collect()
    assert tables.token(rows, "1").count() == 1 and tables.token_page(rows, -3, 1).first()["id"] == "1" and tables.token_page(rows, 5, 9).count() == 0
    with pytest.raises(ValueError):
        tables.workflow_tokens(spark, write(tmp_path / "three.csv", "id,b,m\n1,x,y\n"))
    with pytest.raises(ValueError):
        tables.workflow_tokens(spark, write(tmp_path / "empty.csv", "id,b,m,t\n"))


def test_database_tables(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark._jvm.java.lang.Class.forName(driver)
    statement = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    statement.execute("create table PEOPLE (ID varchar(20), NAME varchar(20))")
    for i in range(20):
        statement.execute(f"insert into PEOPLE values ('{i}', {f"'n{i}'" if i % 3 else 'null'})")
    df = tables.jdbc(spark, url, "PEOPLE", driver=driver)
    assert {r[0]: r[1] for r in df.collect()} == {str(i): f"n{i}" if i % 3 else "" for i in range(20)}
    got = tables.jdbc_get(spark, url, "PEOPLE", "7", driver=driver)
    assert [tuple(r) for r in got.collect()] == [("7", "n7")]
    assert "PushedFilters: [*" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(KeyError):
        tables.jdbc_get(spark, url, "PEOPLE", "99", driver=driver)
    order = sorted(str(i) for i in range(20))
    page = lambda start, size: [r[0] for r in tables.jdbc_page(spark, url, "PEOPLE", start, size, driver=driver).collect()]
    assert page(5, 4) == order[5:9] and page(-2, 2) == order[:2] and page(30, 4) == page(3, 0) == []


def test_logger_and_audit(spark, tmp_path):
    settings = config.load({"logging": {"level": "warn", "file": str(tmp_path / "log" / "a.log"), "enable_audit": True, "audit_file": str(tmp_path / "audit.log")}}).logging
    log = audit.Logger(settings, "s1")
    log.debug("no"), log.info("no"), log.warn("w"), log.error("e"), log.audit("LOGIN", {"b": 2, "a": "x"})
    log.close()
    lines = open(settings.file).read().splitlines()
    assert lines[:2] == ["[KINDRED-s1] [WARN] w", "[KINDRED-s1] [ERROR] e"] and len(lines) == 3 and lines[2].endswith("SESSION=s1 a=x b=2")
    assert open(settings.audit_file).read().startswith("[AUDIT-s1] AUDIT_EVENT=LOGIN TIMESTAMP=")
    assert audit.level("odd") == 1
    for n in range(2):
        audit.append_audit(spark, str(tmp_path / "rows"), [("E", f"t{n}", {"k": n})], "s1")
    assert sorted(r["details"]["k"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["0", "1"]


def test_record_lines(spark, tmp_path):
    own = records(tables.csv(spark, write(tmp_path / "a.csv", CSV)).dropDuplicates(["id"]), ["first_name"], VALIDATE)
    sinks.write_record_lines(own, str(tmp_path / "r"), VALIDATE)
    got = {r["id"]: (r["bits"], r["signature"], r["qgrams"]) for r in tables.record_lines(spark, str(tmp_path / "r")).collect()}
    assert got == {r["id"]: (r["bits"], r["signature"], r["qgrams"]) for r in own.collect()}


def test_config():
    c = config.load("database:\n  type: csv  # kind\n  filename: 'a b.csv'\n  fields:\n    - name:first\n    - zip\nmatching:\n  hamming_threshold: 0\nlisten_port: 9\nunknown: 1\n")
    assert (c.database.type, c.database.filename, c.database.fields, c.listen_port) == ("csv", "a b.csv", ["name:first", "zip"], 9)
    assert (c.matching.hamming_threshold, c.matching.jaccard_threshold, c.security.rate_limit_per_min, c.timeouts.idle_timeout) == (0, 0.32, 5, 300)
    with pytest.raises(ValueError):
        tables.load(None, config.load({"database": {"type": "odd"}}).database)


def limiter(events, limit, seconds):
    """The rule, event by event."""
    state, out = {}, {}
    for i, t, k in sorted(events, key=lambda e: (e[1], e[0])):
        count, reset = state.get(k, (0, None))
        if reset is None or t > reset:
            state[k], out[i] = (1, t + seconds), True
        elif count >= limit:
            out[i] = False
        else:
            state[k], out[i] = (count + 1, reset), True
    return out


def test_rate_limit(spark, tmp_path):
    import random

    random.seed(3)
    events = [(i, random.randint(0, 400), random.choice("abc")) for i in range(200)] + [(900, 0, "d"), (901, 60, "d"), (902, 60, "d"), (903, 61, "d")]
    want = limiter(events, 2, 60)
    df = spark.createDataFrame(events, "i long, s long, k string").select("i", F.timestamp_seconds("s").alias("t"), "k")
    got = {r["i"]: r["allowed"] for r in limits.rate_limited(df, "k", "t", "i", 2).collect()}
    assert got == want
    assert limits.limiter_statistics(limits.rate_limited(df, "k", "t", "i", 2), "k", 2).first()["monitored"] == 4
    folder = str(tmp_path / "in")
    for n, (lo, hi) in enumerate(((0, 150), (151, 300), (301, 500))):
        df.where(f"unix_timestamp(t) between {lo} and {hi}").coalesce(1).write.mode("append").parquet(folder)
    stream = matching.read_rows(spark, folder, df.schema)
    q = limits.rate_limited_stream(stream, "k", "t", "i", 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["i"]: r["allowed"] for r in spark.table("limited").collect()} == want


def test_connections(spark):
    deltas = [1, -1, -1, 1, 1, -1, -1, -1, 1]
    df = spark.createDataFrame([(i, "k", d) for i, d in enumerate(deltas)], "i long, k string, d int")
    got = [r["open"] for r in limits.connections(df, "k", "i", "i", "d").orderBy("i").collect()]
    n, want = 0, []
    for d in deltas:
        n = max(0, n + d)
        want.append(n)
    assert got == want


def test_stream_matching(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "ann lee", "1"), ("s2", "bob", "2"), ("s3", "nobody", "3")], "id string, name string, z string")
    folder = str(tmp_path / "rows")
    for i in ("s1", "s2", "s3"):
        rows.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(folder)
    peer_rows = spark.createDataFrame([("p1", "Ann Lee", "1"), ("p2", "bob", "2")], "id string, name string, z string")
    peer = records(peer_rows, ["name", "z"], VALIDATE).persist()
    q = matching.start(matching.read_rows(spark, folder, rows.schema), peer, ["name", "z"], str(tmp_path / "out"), str(tmp_path / "cp"), VALIDATE, Thresholds(0, 0.9))
    q.awaitTermination(180)
    got = spark.read.json(str(tmp_path / "out" / "json" / "batch=*"))
    assert sorted((r["local_id"], r["peer_id"]) for r in got.collect()) == [("s1", "p1"), ("s2", "p2")]
    assert all(len(r["timestamp"]) == 20 and r["timestamp"].endswith("Z") for r in got.collect())
    assert spark.read.csv(str(tmp_path / "out" / "csv" / "batch=*"), header=True).columns[:3] == ["Local_ID", "Peer_ID", "Timestamp"]


def test_command_line(spark, tmp_path):
    src = write(tmp_path / "a.csv", CSV.replace("2,Bobby,1/2/85,99\n", ""))
    cli.main(["tokenize", "--input", src, "--output", str(tmp_path / "t1.csv")])
    cli.main(["tokenize", "--input", src, "--output", str(tmp_path / "t.enc"), "--encrypt"])
    cli.main(["decrypt", "--input", str(tmp_path / "t.enc"), "--output", str(tmp_path / "t2.csv")])
    cli.main(["intersect", "--first", str(tmp_path / "t1.csv"), "--second", str(tmp_path / "t2.csv"), "--output", str(tmp_path / "m")])
    assert tables.matches_file(spark, str(tmp_path / "m")).count() == 2
    assert [r[0][:2] for r in spark.read.text(str(tmp_path / "m")).limit(3).collect()] == ["# "] * 3
    conf = write(tmp_path / "c.yaml", f"database:\n  type: csv\n  filename: {src}\n  fields:\n    - name:first_name\n    - date:dob\n    - zip:zip\n")
    truth = write(tmp_path / "truth.csv", "a,b\n1,1\n2,2\n")
    cli.main(["validate", "--first", conf, "--second", conf, "--truth", truth, "--output", str(tmp_path / "r")])
    scores, pairs = tables.report_file(spark, str(tmp_path / "r"))
    assert list(scores) == sinks.REPORT_METRICS and scores["recall"] == "1.000000" and scores["total_ground_truth"] == "2"
    assert sorted(map(tuple, pairs.collect())) == [("true_positive", "1", "1"), ("true_positive", "2", "2")]
    cli.main(["pprl", "--first", conf, "--second", conf, "--output", str(tmp_path / "p.json")])
    assert sorted(map(tuple, tables.matches_file(spark, str(tmp_path / "p.json")).collect())) == [("1", "1"), ("2", "2")]
