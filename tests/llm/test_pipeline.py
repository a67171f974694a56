import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import near_roots, slow_targets, slow_tiles

from wirelens.llm import entry, tokens

SF = "/root/testdata/sf0.001"


def staged(spark, tmp_path):
    """The rows before and after each stage, as the stages are run: written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def covered(text, item):
    """Whether greedy tiles of four words or more cover 0.6 of the item's words; all of a shorter item."""
    doc, words = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
    k = min(4, len(words))
    grams = {tuple(doc[p : p + k]) for p in range(len(doc) - k + 1)}
    shared = {q + j for q in range(len(words) - k + 1) if tuple(words[q : q + k]) in grams for j in range(k)}
    if not words or len(shared) < 0.6 * len(words):
        return False
    mine = {tuple(words[q : q + k]) for q in range(len(words) - k + 1)}
    near = {p + j for p in range(len(doc) - k + 1) if tuple(doc[p : p + k]) in mine for j in range(k)}
    number = {w: n for n, w in enumerate(dict.fromkeys(words), 1)}
    part = [number.get(w, 0) if p in near else 0 for p, w in enumerate(doc)]
    part = [x for p, x in enumerate(part) if x or (p and part[p - 1])]
    return sum(n for *_, n in slow_tiles(part, [number[w] for w in words], k)) >= 0.6 * len(words)


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on sf0.001 against a plain version of it."""
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "token_output"]
    stages = staged(spark, tmp_path)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n][2] == columns for n in list(stages)[:4])

    before, after, _ = stages["language_id"]
    kept = {r.doc_id: r for r in after}
    assert set(kept) == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    right = [kept[r.doc_id].lang == r.lang for r in before if r.lang and r.doc_id in kept]
    assert all(right) and all(r.lang for r in after)

    before, after, _ = stages["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in after) == [before[k].doc_id for k in near_roots([r.text for r in before])]

    before, after, _ = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not any(covered(r.text, x) for x in items))

    before, after, _ = stages["source_mix"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    sizes = {s: sum(words(r) for r in before if r.source == s) for s in {r.source for r in before}}
    for s, target in slow_targets(sizes, (5, 2, 1), 3).items():
        taken = sum(words(r) for r in after if r.source == s)
        assert abs(taken - target) <= max(words(r) for r in before if r.source == s)
    assert max(np.unique([r.doc_id for r in after], return_counts=True)[1]) <= 3 and set(after) <= set(before)

    before, after, _ = stages["token_output"]
    tok = Tokenizer.from_file(tokens.default_tokenizer()[0])
    ids = [(r.doc_id, [*tok.encode(r.text, add_special_tokens=False).ids, 2]) for r in before]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == sorted((d, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for d, e in ids)
    start = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(after, key=lambda r: r.start)] == sorted(r.doc_id for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where(F.col("n_tokens") > 0).count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).count()


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in entry.QUERIES] == [f"op{n}" for n in range(1, 11)]
