"""What rerankers, agents and verifiers are sent, and what is written of tables, prompts and records."""

import glob
import json
import tempfile

from pyspark.sql import functions as F

from tamarack.operators import candidates, rules, snippets
from tamarack.sources import records


def size(value):
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def shortened(item, text, items):
    cut = lambda s: s if len(s) <= text else s[: text - 15].rstrip() + " ...[truncated]"
    return {k: cut(v) if isinstance(v, str) else v[:items] for k, v in item.items()} | {"_truncated": True}


def within(seen, most, text, items):
    if size(seen) <= most:
        return seen
    out, left = [], most
    for item in seen:
        if left <= 0:
            break
        small = item if size(item) <= min(left, most // 2) else shortened(item, text, items)
        left -= size(small)
        out.append(small)
    return out


def test_observations_keep_to_a_budget(spark):
    rows = {
        1: [{"action": "a", "content": "x" * 20, "hits": ["p"]}], 2: [{"action": "a", "content": "y" * n, "hits": ["h" * 5] * 9} for n in (10, 90, 300, 20, 400, 5)],
        3: [{"action": "é", "content": "z" * 500, "hits": []}] * 6, 4: [{"action": "b", "content": "q" * k, "hits": ["é"] * k} for k in range(12)],
    }
    flat = [(q, i, x["action"], x["content"], x["hits"]) for q, seen in rows.items() for i, x in enumerate(seen)]
    df = spark.createDataFrame(flat, "query_id long, place long, action string, content string, hits array<string>")
    for most in (60, 300, 500, 5000):
        got = {}
        for r in candidates.compact_observations(df, max_chars=most, long_text=100, long_list=2).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(json.loads(r.observation))
        assert got == {q: within(seen, most, 100, 2) for q, seen in rows.items()}


def test_prompts_of_agents_and_verifiers(spark):
    row = spark.createDataFrame([("why", ["a", "b"], ["saw"], 1), ("why", ["a"], None, 3)], "q string, files array<string>, seen array<string>, step int")
    asked = candidates.agent_prompt(F.col("q"), F.col("files"), F.col("seen"), F.col("step"), task="look", rules=("stay",), tools=("search", "read"), max_steps=3, top=10)
    first, last = (json.loads(r.x) for r in row.select(asked.alias("x")).collect())
    assert first == {"task": "look", "step": 1, "max_steps": 3, "rules": ["stay"], "actions": ["search", "read", "finish"], "query": "why", "candidates": ["a", "b"], "observations": ["saw"], "top_output": 2}
    assert last["actions"] == ["finish"] and last["observations"] is None and last["top_output"] == 1
    checked = candidates.verifier_prompt(F.col("q"), F.col("files"), F.col("seen"), F.col("seen"), task="check", rules=(), top=1)
    assert json.loads(row.select(checked.alias("x")).first().x)["proposed_ranking"] == ["a", "b"]


def test_full_candidates_have_snippets_and_evidence(spark):
    sources = spark.createDataFrame([("m/Mockito.java", "p", ["Mock"], ["createType", "run"], "int a;\nvoid createType() {\n}\nspy it"), ("x.java", "p", [], [], "spy")], "file string, package string, classes array<string>, methods array<string>, text string")
    ranked = spark.createDataFrame([(1, 1, 3.5, "m/Mockito.java", 90.0, ["direct_class_hint:Mock"]), (1, 2, 2.0, "gone.java", 0.0, []), (1, 3, 1.0, "x.java", 0.0, None)], "query_id long, rank int, score double, file string, direct_boost double, reasons array<string>")
    queries = spark.createDataFrame([(1, "spy fails", "")], "query_id long, query string, trace string")
    got = {r.file: r for r in candidates.full(ranked, sources, queries, max_lines=3).collect()}
    assert set(got) == {"m/Mockito.java", "x.java"}
    assert json.loads(got["m/Mockito.java"].evidence) == {"direct_boost": 90.0, "reasons": ["direct_class_hint:Mock"]}
    terms = rules.semantic_terms(sources.filter("file like 'm%'").selectExpr("1 AS query_id", "*", "array('spy') AS query_terms")).first().terms
    pair = spark.createDataFrame([(1, "m/Mockito.java", " ".join(terms) + "\nspy fails", "")], "query_id long, file string, query string, trace string")
    assert got["m/Mockito.java"].relevant_snippet == snippets.snippets(pair, sources, max_lines=3).first().snippet
    assert got["x.java"].relevant_snippet == "1: spy"


def written(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/**/part-*", recursive=True)))


def test_sinks(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("b,1", 1.5, None), ('a "q"', None, "x")], "name string, mean double, note string").coalesce(1)
    records.write_csv(df, f"{base}/a")
    assert written(f"{base}/a").splitlines() == ["name,mean,note", '"b,1",1.5,NA', '"a \\"q\\"",NA,x']
    records.write_csv(df, f"{base}/b", columns=["note", "absent", "name"])
    assert written(f"{base}/b").splitlines()[:2] == ["note,absent,name", 'NA,NA,"b,1"']
    records.write_csv(df, f"{base}/c", missing="", columns=["name", "note"], quoted=False)
    assert sorted(written(f"{base}/c").splitlines()) == sorted(["name,note", "b,1,", 'a "q",x'])
    records.write_json(df, f"{base}/d")
    assert json.loads(written(f"{base}/d").split("}\n")[0] + "}") == {"mean": 1.5, "name": "b,1", "note": None}
    records.write_prompts(spark.createDataFrame([(1, "a", "one\ntwo"), (2, "b", "three")], "query_id int, step string, prompt string"), f"{base}/e", "query_id", "step")
    assert written(f"{base}/e/query_id=1/step=a") == "one\ntwo\n" and written(f"{base}/e/query_id=2/step=b") == "three\n"
    lines = [r.line for r in records.markdown_table(df, "name").collect()]
    assert lines == ["| name | mean | note |", "| --- | --- | --- |", '| a "q" | NA | x |', "| b,1 | 1.5000 | NA |"]
    records.write_jsonl(df, f"{base}/f")
    back = records.read_jsonl(spark, f"{base}/f", "name string, mean double, note string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with open(f"{base}/f/part-x.json", "w") as handle:
        handle.write("{broken\n")
    assert [r._corrupt_record for r in records.read_jsonl_report(spark, f"{base}/f", "name string").collect() if r._corrupt_record] == ["{broken"]


def test_csv_values_come_back(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    values = ["", " ", " a ", "a\rb", "a\r\nb", "a\nb", "\r", "\n", ",", '"', '""', "\\", '\\"', "a\\", "NA", "\u2028", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, head string").coalesce(1)
    for missing, lost, last in (("NA", "NA", "NA,NA,16\n"), ("", None, "\n,,16\n")):
        path = f"{base}/csv{missing}"
        records.write_csv(df, path, missing, columns=["head", "absent", "i"])
        got = sorted((int(r.i), r.head, r.absent) for r in records.read_bugs(spark, path).collect())
        assert got == [(i, lost if v is None else v, lost) for i, v in enumerate(values)]
        assert written(path).endswith(last)


def test_selected_ids_of_reports(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    for k, ids in enumerate((["x", "y"], ["y", "z"], [])):
        with open(f"{base}/{k}.json", "w") as handle:
            json.dump({"selected_bug_ids": ids, "other": 1}, handle, indent=2)
    assert sorted(r.query_id for r in records.selected_ids(spark, f"{base}/0.json", f"{base}/1.json", f"{base}/2.json").collect()) == ["x", "y", "z"]
