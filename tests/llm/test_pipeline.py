"""The pipeline's stages on odd rows, and its whole against brute force."""

import hashlib
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import bpe, common  # noqa: E402


def test_stages_keep_columns_and_pass_their_rows_on(spark, sf, odd_docs):
    docs = odd_docs
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.shelve(stage(spark, docs, sf))
        assert docs.columns == odd_docs.columns, name
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_whole(spark, sf):
    import public_tokenizers
    import tiktoken
    from test_operators import linked, words

    all_docs = common.table(spark, sf, "documents")
    labels = common.table(spark, sf, "labels")
    kept = {}
    from tessera.llm import mixing, quality, suffix

    good = {r["doc_id"] for r in quality.verdicts(all_docs, labels).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect() if r["doc_id"] in good]
    _, label = linked(rows, 5, 80)
    for (d, t), x in sorted(zip(rows, label)):
        kept.setdefault(x, (d, t))
    seen, cleaned = set(), []
    for d, t in sorted(kept.values()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - suffix.LENGTH + 1):
            if b[p : p + suffix.LENGTH] in seen:
                gone[p : p + suffix.LENGTH] = b"\1" * suffix.LENGTH
            seen.add(b[p : p + suffix.LENGTH])
        out, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        cleaned.append((d, "".join(out)))
    source = {r["doc_id"]: r["source"] for r in all_docs.collect()}
    df = spark.createDataFrame([(d, t, source[d]) for d, t in cleaned], "doc_id long, text string, source string")
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    want = Counter()
    for r in mixing.remixed(df).collect():  # its own test compares it with brute force
        ids = tokenizer.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, sf).collect())
    assert got == want
