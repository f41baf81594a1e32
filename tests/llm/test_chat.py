import hashlib
import random

from threadgraph.llm import chat as C


def test_windows_read_back(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>\n", "<|im_start|>", "<\\|", "<", "|", "\n", "word", " ", "<\\\\|x", "é", "%0A", "😀"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "odd\nrole%", ""]) if t else rng.choice(["system", "user"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 200])))))
    rows += [(50, 0, "system", "alone"), (51, 0, None, None)]
    rows += [(52, t, "assistant" if t % 2 else "user", f"turn {t} " + "w " * 40) for t in range(300)] + [(None, 0, "user", "x"), (53, 1, "user", "twice"), (53, 1, "user", "twice")]
    df = spark.createDataFrame([(c, t, r, x, "z", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, pos string, span int")
    windows = C.format_chats(df, 200, 60, 3)
    got = {r["conv_id"]: r for r in C.digests(windows).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))
    tokens = lambda text: sum(len(p.split(b"\n", 1)[1].split()) + C.MARKS for p in text.encode().split(C.END.encode())[:-1])
    for w in windows.filter("conv_id = 52").collect():
        assert tokens(w["text"]) <= 200
    assert windows.filter("conv_id = 52 and window > 0 and repeated = 0").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_chats(df)).count() == 0
