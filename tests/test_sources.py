import json
import random
import os

import pytest

from corpusprobe.sources import sinks
from corpusprobe.sources import tasks as tk
from corpusprobe.sources.prompts import read_prompt_folder, read_task_list


def test_prompt_folder(spark, tmp_dir):
    d = os.path.join(tmp_dir, "prompts")
    os.makedirs(os.path.join(d, "flagged"))
    json.dump(["p one", "p two"], open(os.path.join(d, "taskA.json"), "w"))
    json.dump(None, open(os.path.join(d, "taskB.json"), "w"))
    open(os.path.join(d, "taskC.txt"), "w").write("line one\nline two\nlast")
    open(os.path.join(d, "flagged", "ignored.json"), "w").write("[\"x\"]")
    rows = sorted(tuple(r) for r in read_prompt_folder(spark, d).collect())
    assert rows == [("taskA.json", 0, "p one"), ("taskA.json", 1, "p two"),
                    ("taskC.txt", 0, "line one"), ("taskC.txt", 1, "line two"), ("taskC.txt", 2, "last")]
    kept = sorted(r["text"] for r in read_prompt_folder(spark, d, strip_newline=False).collect()
                  if r["task"] == "taskC.txt")
    assert kept == ["last", "line one\n", "line two\n"]


def test_prompt_folder_rejects_other_extensions(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bad")
    os.makedirs(d)
    open(os.path.join(d, "x.csv"), "w").write("a")
    with pytest.raises(NotImplementedError):
        read_prompt_folder(spark, d)


def test_task_list(spark, tmp_dir):
    p = os.path.join(tmp_dir, "tasks.txt")
    open(p, "w").write("a_task\nb_task\n")
    assert [r["task"] for r in read_task_list(spark, p).collect()] == ["a_task", "b_task"]


def test_cached_task_roundtrip(spark, tmp_dir):
    d = os.path.join(tmp_dir, "cache")
    os.makedirs(d)
    info = {"features": {"inputs_pretokenized": {"shape": [], "dtype": "string"},
                         "targets": {"shape": [None], "dtype": "int32"},
                         "is_correct": {"shape": [], "dtype": "bool"}}, "num_shards": 2}
    json.dump(info, open(os.path.join(d, "test.info.json".replace("test.info", "info.test")), "w"))
    for shard in range(2):
        with open(os.path.join(d, f"test.jsonl-0000{shard}-of-00002"), "w") as f:
            f.write(json.dumps({"inputs_pretokenized": "aGVsbG8=", "targets": [1, 2], "is_correct": 1}) + "\n")
    df = tk.load_cached_task(spark, d, "test", fmt="json")
    assert dict(df.dtypes) == {"inputs_pretokenized": "binary", "targets": "array<int>", "is_correct": "boolean"}
    assert [r["text"] for r in tk.decode_inputs(df).collect()] == ["hello", "hello"]


def test_split_fallback_and_pending(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    avail = spark.createDataFrame([("a", "test"), ("a", "validation"), ("b", "validation"), ("c", "train")],
                                  "task string, split string")
    got = {r["task"]: r["split"] for r in tk.split_fallback(tasks, avail).collect()}
    assert got == {"a": "test", "b": "validation", "c": None}
    done = spark.createDataFrame([("a",)], "task string")
    assert sorted(r["task"] for r in tk.pending_tasks(tasks, done).collect()) == ["b", "c"]


def test_load_dataset_arguments(spark, tmp_dir):
    with pytest.raises(NotImplementedError):
        tk.load_dataset(spark)
    with pytest.raises(ValueError):
        tk.load_dataset(spark, name="x", path="y")
    p = os.path.join(tmp_dir, "ds.json")
    open(p, "w").write('{"text": "a"}\n{"text": "b"}\n')
    assert tk.load_dataset(spark, path=p).count() == 2


def test_sinks_roundtrip(spark, tmp_dir):
    counts = spark.createDataFrame([("t1", "q", 3), ("t2", "r", 0)], "task string, query string, n bigint")
    out = os.path.join(tmp_dir, "counts")
    sinks.write_counts(counts, out)
    sinks.write_counts(counts.where("task = 't1'").selectExpr("task", "query", "n + 1 AS n"), out)
    back = sorted(tuple(r) for r in spark.read.json(out).select("task", "query", "n").collect())
    assert back == [("t1", "q", 4), ("t2", "r", 0)]
    lines = spark.createDataFrame([(2, "5 6"), (1, "3 4")], "doc_id bigint, line string")
    tl = os.path.join(tmp_dir, "tok")
    sinks.write_token_lines(lines, tl, keep_order=True)
    assert sorted(r["value"] for r in spark.read.text(tl).collect()) == ["3 4", "5 6"]


def test_jsonl_lines_and_word_list(spark, tmp_dir):
    from corpusprobe.sources.corpus import read_corpus_lines, read_jsonl_corpus, read_word_list
    p = os.path.join(tmp_dir, "c.jsonl")
    open(p, "w").write('{"text": "a b", "url": "x"}\n{"text": "c", "url": "y"}\n')
    assert sorted(r["text"] for r in read_jsonl_corpus(spark, p).collect()) == ["a b", "c"]
    lines = read_corpus_lines(spark, p).collect()
    assert sorted(r["line_no"] for r in lines) == [0, 1]
    w = os.path.join(tmp_dir, "words.json")
    json.dump(["alpha", "beta"], open(w, "w"))
    assert [(r["idx"], r["word"]) for r in read_word_list(spark, w).collect()] == [(0, "alpha"), (1, "beta")]


def test_task_extraction_chain(spark, tmp_dir):
    from corpusprobe.sources import prompts as pr
    out = os.path.join(tmp_dir, "prompts")
    tasks = spark.createDataFrame([("a", "test"), ("b", None), ("c", "train")], "task string, split string")
    assert tk.pending_tasks(tasks, tk.done_from_outputs(spark, out)).count() == 3
    first = tasks.where("task <> 'c'")
    found = spark.createDataFrame([("a", "test", 0, "p q"), ("a", "test", 1, "r")], pr.WRITTEN_SCHEMA)
    sinks.write_prompts(found, out, first)
    assert [r["task"] for r in tk.pending_tasks(tasks, tk.done_from_outputs(spark, out)).collect()] == ["c"]
    sinks.write_prompts(spark.createDataFrame([("c", "train", 0, "s")], pr.WRITTEN_SCHEMA), out)
    assert tk.pending_tasks(tasks, tk.done_from_outputs(spark, out)).count() == 0
    rows = sorted(tuple(r) for r in pr.read_written_prompts(spark, out).collect())
    assert rows == [("a", "test", 0, "p q"), ("a", "test", 1, "r"), ("c", "train", 0, "s")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_folder_without_prompt_files_is_refused(spark, tmp_dir):
    from corpusprobe.sources.prompts import read_prompt_folder
    with pytest.raises(FileNotFoundError):
        read_prompt_folder(spark, tmp_dir)


def test_all_sinks_roundtrip(spark, tmp_dir):
    prompts = spark.createDataFrame([("t", "test", 0, "p")], "task string, split string, prompt_id bigint, text string")
    sinks.write_prompts(prompts, os.path.join(tmp_dir, "p"))
    assert spark.read.json(os.path.join(tmp_dir, "p")).select("task", "split", "text").collect()[0] == ("t", "test", "p")
    per_task = spark.createDataFrame([("t", 1)], "task string, flagged bigint")
    per_prompt = spark.createDataFrame([("t", 0, ["a b"])], "task string, prompt_id bigint, tiles array<string>")
    sinks.write_flags(per_task, per_prompt, os.path.join(tmp_dir, "f"))
    assert spark.read.json(os.path.join(tmp_dir, "f", "flagged_queries")).first()["tiles"] == ["a b"]
    counts = spark.createDataFrame([("reverse", "abc", "cba", 2)], "transform string, word string, query string, n bigint")
    avgs = spark.createDataFrame([("reverse", 2.0)], "transform string, avg_n double")
    sinks.write_transform_counts(counts, avgs, os.path.join(tmp_dir, "t"))
    assert spark.read.json(os.path.join(tmp_dir, "t", "avg_count")).first()["avg_n"] == 2.0
    idx = spark.createDataFrame([("a b c d e", 0)], "ngram string, ngram_id bigint")
    sinks.write_table(idx, os.path.join(tmp_dir, "i"))
    assert spark.read.parquet(os.path.join(tmp_dir, "i")).first() == ("a b c d e", 0)
    emb = spark.createDataFrame([(1, "x", [0.5, 0.5])], "doc_id bigint, text string, embedding array<float>")
    sinks.write_embeddings(emb, os.path.join(tmp_dir, "e"))
    assert spark.read.json(os.path.join(tmp_dir, "e")).first()["embedding"] == [0.5, 0.5]
    words = spark.createDataFrame([(0, "hello")], "idx bigint, word string")
    sinks.write_word_list(words, os.path.join(tmp_dir, "w"))
    from corpusprobe.sources.corpus import read_word_list
    assert [tuple(r) for r in read_word_list(spark, os.path.join(tmp_dir, "w")).collect()] == [(0, "hello")]


def test_transform_selection_keeps_registry_order():
    from corpusprobe.functions.wordforms import select_transforms
    assert list(select_transforms({"cycles": True, "reverse": True, "insertion": False})) == ["reverse", "cycles"]
    with pytest.raises(KeyError):
        select_transforms(["nope"])


def test_frequency_list_file_and_test_words(spark, tmp_dir):
    from corpusprobe.operators.probing import read_frequency_list, test_words
    p = os.path.join(tmp_dir, "count_1w.txt")
    words = ["the", "house", "extraordinarily", "garden", "be", "window", "rooms"]
    open(p, "w").write("".join(f"{w}\t{1000 - i}\n" for i, w in enumerate(words)))
    freq = read_frequency_list(spark, p)
    assert [(r["rank"], r["word"]) for r in freq.orderBy("rank").collect()] == list(enumerate(words))
    tw = test_words(freq, limit=3)
    assert [(r["idx"], r["word"]) for r in tw.orderBy("idx").collect()] == [(0, "house"), (1, "garden"), (2, "window")]


def test_line_keys_do_not_depend_on_splits(spark, tmp_dir):
    from corpusprobe.sources.corpus import located_lines, read_corpus_lines, read_jsonl_corpus
    rng = random.Random(2)
    texts = {"a b.txt": [], "c.txt": ["", "x", ""], "d.txt": ["only"], "e.txt": ["y" * 9000, "z"]}
    texts["a b.txt"] = ["é" * rng.randrange(0, 90) + rng.choice(["", "\r"]) for _ in range(700)]
    want = {}
    position = 0
    for name, lines in sorted(texts.items()):
        ended = name != "d.txt"
        open(os.path.join(tmp_dir, name), "w", newline="").write("\n".join(lines) + ("\n" if ended else ""))
        for i, line in enumerate(lines):
            want[position] = (name, i, ended or i + 1 < len(lines), line.removesuffix("\r"))
            position += len(line.encode()) + 1
    keys = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    kept = [spark.conf.get(k, None) for k in keys]
    try:
        for size, few in (("1m", "1"), ("500b", "40"), ("77b", "1000")):
            for key, value in zip(keys, (size, "0b", few), strict=True):
                spark.conf.set(key, value)
            rows = located_lines(spark, f"{tmp_dir}/*.txt").collect()
            got = {r["position"]: (os.path.basename(r["file"]).replace("%20", " "), r["line_no"], r["terminated"], r["line"]) for r in rows}
            assert len(rows) == len(want) and got == want
            assert len({(r["doc_id"], r["line_no"]) for r in read_corpus_lines(spark, f"{tmp_dir}/*.txt").collect()}) == len(want)
            open(os.path.join(tmp_dir, "c.jsonl"), "w").write("".join(json.dumps({"text": f"t{i}", "u": 1}) + "\n" for i in range(60)) + "no json\n\n")
            docs = [tuple(r) for r in read_jsonl_corpus(spark, f"{tmp_dir}/c.jsonl").orderBy("doc_id").collect()]
            assert [t for _, t in docs] == [f"t{i}" for i in range(60)] + [None]
            assert docs[:2] == [(0, "t0"), (len('{"text": "t0", "u": 1}') + 1, "t1")]
    finally:
        for key, value in zip(keys, kept, strict=True):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_text_prompts_are_read_line_by_line(spark, tmp_dir):
    from corpusprobe.sources.prompts import read_prompt_folder
    open(os.path.join(tmp_dir, "my task.txt"), "w").write("one\n\ntwo \nlast")
    open(os.path.join(tmp_dir, "empty.txt"), "w").write("")
    rows = [tuple(r) for r in read_prompt_folder(spark, tmp_dir).orderBy("prompt_id").collect()]
    assert rows == [("my task.txt", 0, "one"), ("my task.txt", 1, ""), ("my task.txt", 2, "two "), ("my task.txt", 3, "last")]
    kept = [r["text"] for r in read_prompt_folder(spark, tmp_dir, strip_newline=False).orderBy("prompt_id").collect()]
    assert kept == ["one\n", "\n", "two \n", "last"]


def test_every_split_without_prompts_counts_as_finished(spark, tmp_dir):
    from corpusprobe.sources import prompts as pr
    out = os.path.join(tmp_dir, "p")
    found = spark.createDataFrame([("a", "test", 0, "p")], pr.WRITTEN_SCHEMA)
    sinks.write_prompts(found, out, spark.createDataFrame([("a", "test"), ("a", "train"), ("b", "test")], "task string, split string"))
    assert sorted((r["task"], r["split"], r["prompt_id"]) for r in pr.written_prompts(spark, out).collect()) == [
        ("a", "test", 0), ("a", "train", None), ("b", "test", None)]


def test_dataset_by_name_config_and_split(spark, tmp_dir):
    for config, split, text in (("en", "train", "a"), ("en", "test", "b"), ("de", "test", "c")):
        os.makedirs(os.path.join(tmp_dir, "web", config), exist_ok=True)
        open(os.path.join(tmp_dir, "web", config, f"{split}-00000.json"), "w").write(json.dumps({"text": text}) + "\n")
    load = lambda **kw: sorted(r["text"] for r in tk.load_dataset(spark, "web", root=tmp_dir, **kw).collect())
    assert load(config="en") == ["a", "b"] and load(config="en", split="test") == ["b"] and load(config="de", split="test") == ["c"]
    by_path = os.path.join(tmp_dir, "web", "en")
    assert [r["text"] for r in tk.load_dataset(spark, path=by_path, split="train").collect()] == ["a"]
    spark.createDataFrame([("x", "en", "test"), ("y", "de", "test")], "text string, config string, split string"
                          ).createOrReplaceTempView("web_table")
    assert [tuple(r) for r in tk.load_dataset(spark, "web_table", "en", split="test").collect()] == [("x",)]
    with pytest.raises(ValueError):
        tk.load_dataset(spark, "web_table", "en", split="test", path="p")
    spark.createDataFrame([("x",)], "text string").createOrReplaceTempView("plain_table")
    with pytest.raises(ValueError):
        tk.load_dataset(spark, "plain_table", split="test")
