import random
import re

import pyarrow as pa

from lumigrid.llm.compression_bands import measure


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
    hit = {j for v in grams.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\nx \nx", "é#é %|\né#é %|"]
    texts += ["".join(rng.choice(["a ", "b ", "é", "\n", "#", " ", "a b a ", "A"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = measure(pa.array(texts))
    for r, t in enumerate(texts):
        assert tuple(int(c[r]) for c in got[:5]) == brute(t), repr(t)


def test_verdicts():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice(["th", "er", "in", "on", "at", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    half = prose[:6000] + "same words again " * 1200
    verdict = measure(pa.array([prose, "spam " * 900, noise, half, None, ""]))[8]
    assert verdict.tolist() == [True, False, False, False, False, False]
