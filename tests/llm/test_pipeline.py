"""The corpus pipeline against plain Python that follows the same decisions."""

import random

import corpus_pipeline
from quire.llm import langid, linededup, packing, secret_scan
from quire.llm.queries import vocabulary
from tests.llm.test_text_operators import by_distance


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(0)
    syllables = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["stra", "ich", "über", "keit"]}
    rows = []
    for i in range(160):
        k = "aa" if i % 2 else "bb"
        body = "\n".join(" ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(20)) for _ in range(3))
        rows.append([i, body + "\nShared licence line.", k, f"s{i % 13}"])
    rows[20][1] = rows[21 - 1][1] + "\ntoken = abcdefgh12345"
    rows += [[200, rows[3][1], "aa", "s1"], [201, None, None, "s1"], [202, "123 !!!", None, "s2"], [203, "Shared licence line.", "aa", "s3"], [204, "", "aa", "s3"]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    state = {r[0]: r[1] for r in rows}
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")

    step = corpus_pipeline.language(spark, step, str(tmp_path))
    assert step.columns == columns
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    assert kept == {i: t for i, t in state.items() if i not in (201, 202, 204)}

    step = corpus_pipeline.line_dedup(spark, step, str(tmp_path))
    assert step.columns == columns
    lines = {r["doc_id"]: r["text"] for r in step.collect()}
    assert lines[0] == kept[0] and 203 not in lines
    assert all(lines[i] == "\n".join(x for x in t.split("\n") if x != "Shared licence line.") for i, t in kept.items() if i not in (0, 203))
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect())

    step = corpus_pipeline.near_dedup(spark, step, str(tmp_path))
    one = {r["doc_id"]: r["text"] for r in step.collect()}
    from quire.llm.simhash import fingerprint

    ids = sorted(lines)
    names = by_distance([fingerprint(lines[i]) for i in ids])
    assert sorted(one) == [ids[k] for k in sorted(set(names))] and 200 not in one

    step = corpus_pipeline.secrets(spark, step, str(tmp_path))
    safe = {r["doc_id"]: r["text"] for r in step.collect()}
    assert set(safe) == set(one) and "abcdefgh12345" not in safe[20] and "[SECRET]" in safe[20]
    assert all(safe[i] == one[i] for i in one if not secret_scan.find(one[i]))

    packed = corpus_pipeline.pack(spark, step, str(tmp_path)).collect()
    ids_of = packing.tokenizer(vocabulary())
    want = sum(len(ids_of(t)) // 4 + 1 for t in safe.values())
    assert sum(r["length"] for r in packed) == want and {r["doc_id"] for r in packed} == set(safe)
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert linededup.MIN_SITES <= 13 and langid.UND == "und"
