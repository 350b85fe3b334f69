"""Separator scan against files split in memory."""

import numpy as np
import pytest

from ledgerlens.llm import tokenfiles
from ledgerlens.llm.tokens import word_tokenizer_path


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    want, paths = set(), []
    for f in range(6):
        lengths = [[], [0], [0, 0, 0], [5, 0, 13], [40], rng.integers(0, 9, 30).tolist()][f]
        ids, start = [], 0
        for k, n in enumerate(lengths):
            last = f == 4 and k == 0  # a file without its last separator
            ids += [*rng.integers(0, 9, n), *([] if last else [9])]
            want.add((f, k, start, n))
            start = len(ids)
        path = tmp_path / f"{f}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes() + b"x" * (f == 5))
        paths.append((str(path),))
    files = spark.createDataFrame([*paths, (None,), paths[3]], "path string")
    got = tokenfiles.count_tokens(spark, files, separator=9, block_tokens=block).collect()
    assert {(int(r["path"][-5]), r["ordinal"], r["start"], r["n_tokens"]) for r in got} == want
    assert len(got) == len(want)


def test_written_documents_are_counted(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "Some words, and more.", 0), (2, None, 0), (3, "", 0), (None, "a <|endoftext|> b", 0),
            (5, "long " * 20_000, 0), (5, "same", 0), (5, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path int")
    written = tokenfiles.write_token_files(
        docs, str(tmp_path), word_tokenizer_path(), file_bytes=1000)
    got = tokenfiles.count_tokens(spark, written, block_tokens=300).join(written, ["path", "ordinal"])
    tokenizer = Tokenizer.from_file(word_tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = [(i or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in got.collect()) == sorted(want)
    empty = tokenfiles.write_token_files(docs.limit(0), f"{tmp_path}/none", word_tokenizer_path())
    assert tokenfiles.count_tokens(spark, empty).count() == 0
