import hashlib
import struct

import public_tokenizers
from helpers import TEXTS, docs

from threadgraph.llm.bpe import decode, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Ünïcode ÀÉ don't we'll 1234 x²", "ΟΔΟΣ Σ İstanbul", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "tab\tnl\nnbsp\xa0x y\x85z\x1cq", "日本語テキスト 123", "é Å",
       "😀 emoji 👍🏽", "­​zero", "ǅ ß ŉ", "'S 'T 'sam", "_under_score__ --- ...", "\x00nul"]


def test_like_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(ODD)]
    for hot in (0, 3, 1000):
        got = sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encode_decode(docs(spark, rows), PATH, hot).collect())
        want = []
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want.append((i or 0, len(ids), struct.pack(f"<{len(ids)}I", *ids), tok.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want)


def test_empty_and_decode(spark):
    from tokenizers import Tokenizer

    assert encode_decode(docs(spark, []), PATH).count() == 0
    tok = Tokenizer.from_file(PATH)
    texts = {1: "hello world, again and again", 2: "", 3: "<|endoftext|> x"}
    ids = spark.createDataFrame([(i, tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode(ids, PATH).collect()}
    assert got == {i: tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in texts.items()}
    assert hashlib.sha256(b"").hexdigest()
