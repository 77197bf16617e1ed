"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from topictide.llm import (bpe, chat, decontamination, langid, licenses, line_dedup, lm_scoring, ngram_join,
                           quality_rules, queries, toxicity)

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [None, "", "   \n\t ", "...!?", "one", "A line with five words here\nA line with five words here", LONG,
         "same words in the same order twice over and over", "same words in the same order twice over and over", "\x00 é 漢 \U0001f600 x"]
# Columns named like results and internals of the operators.
EXTRA = "id long, n_words long, score double, kept boolean, component_id long, removed_lines long, tag long, ids string, text_ string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a text whose id is null", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def path():
    return public_tokenizers.path(queries.RANKS)


def operators(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 3 as int) as toxic")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same words in the same order twice over and over"), (4, "one")], "item_id long, text string")
    stats = quality_rules.text_statistics(docs)
    return {
        "lm": lambda: lm_scoring.score(docs),
        "bpe": lambda: bpe.decode(bpe.encode(docs, path(), public_tokenizers.PATTERN), path()),
        "lines": lambda: line_dedup.dedup_lines(docs.drop("removed_lines")),
        "lang": lambda: langid.identify(docs, langid.train(docs)),
        "ngram": lambda: ngram_join.near_duplicates(docs),
        "quality": lambda: stats.withColumn("verdict", quality_rules.decision_list(quality_rules.train(stats, labels))),
        "leaks": lambda: decontamination.search(decontamination.build_index(docs), bench),
        "near": lambda: decontamination.search(decontamination.build_index(docs), bench, slop=20),
        "toxic": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "licenses": lambda: licenses.scan(docs),
    }


NAMES = ["lm", "bpe", "lines", "lang", "ngram", "quality", "leaks", "near", "toxic", "licenses"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, docs, name):
    n = operators(spark, docs)[name]().count()
    assert n == (0 if name == "licenses" else len(TEXTS) + 2)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark, empty)[name]().count() == 0


def test_defined_results(spark, docs):
    found = operators(spark, docs)
    tokens = {r.doc_id: r for r in found["bpe"]().collect()}
    both = {r.doc_id: r for r in bpe.round_trip(docs, path(), public_tokenizers.PATTERN).collect()}
    assert both == tokens
    assert bytes(tokens[0].ids) == b"" and bytes(tokens[1].decoded) == b""
    assert all(bytes(tokens[i].decoded) == t.encode() for i, t in enumerate(TEXTS) if t)
    lang = {r.doc_id: r for r in found["lang"]().collect()}
    assert [lang[i].lang_pred for i in range(4)] == ["und"] * 4 and lang[4].lang_pred in ("de", "en")
    groups = {r.doc_id: r for r in found["ngram"]().collect()}
    assert [groups[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    assert groups[7].component_id == groups[8].component_id == 7 and groups[1].component_id == 1
    lines = {r.doc_id: r for r in found["lines"]().collect()}
    assert lines[0].text is None and lines[1].text == "" and lines[5].text == "A line with five words here"
    assert lines[7].removed_lines == 0 and lines[8].text == "" and lines[None].removed_lines == 0
    assert {"component_id", "score", "ids"} <= set(found["lines"]().columns)
    leaks = {r.id: r for r in found["leaks"]().collect()}
    assert [m.item for m in leaks[7].matches] == ["3"] and [m.item for m in leaks[4].matches] == ["4"]
    assert (leaks[7].matches[0].start, leaks[7].matches[0].stop) == (0, 10) and not leaks[0].matches
    scores = {r.doc_id: r.log_score for r in found["lm"]().collect()}
    assert scores[0] == scores[1] == 0 and scores[7] == scores[8] < 0
    toxic = [r.score for r in found["toxic"]().collect()]
    assert all(0 <= s <= 1 for s in toxic)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(9, "same words in the same order twice over and over")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (docs, empty):
        at = d
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if i < 4:
                assert out.columns == [c for c in at.columns if c != "removed_lines" or "removed_lines" in out.columns]
            out.write.parquet(f"{tmp_path}/{'some' if d is docs else 'none'}{i}")
            at = spark.read.parquet(f"{tmp_path}/{'some' if d is docs else 'none'}{i}")
        ids = {r.doc_id for r in at.collect()}
        assert ids == (set() if d is empty else {4, 5, 6, 9, None})


def test_conversations(spark):
    rows = [(1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "a \\ b <s> \\[INST]"), (1, 0, "system", "<</SYS>>"), (2, 0, "assistant", None),
            (3, 0, "tool", "<|role:x|>y<|end|>"), (3, 1, None, "z"), (4, None, "user", ""), (4, 1, "user", "\\"), (4, 1, "user", "\\"), (None, 0, "user", "é\n漢")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "true as loss")
    segments = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(segments).collect()}
    said: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        said.setdefault(c, []).append((role or "", text or ""))
    for c, turns in said.items():
        assert back[c].n_turns == len(turns)
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in back.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    template = chat.Template()
    for r in segments.where("loss").collect():
        assert not any(c in r.text for c in template.controls)
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0
