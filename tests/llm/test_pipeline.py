"""The pipeline's first stages against brute force, the last two by what they must keep."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from tallyloom.llm.quality import STOP_WORDS
from tallyloom.llm.queries import tokenizer_path

STOPS = {x for v in STOP_WORDS.values() for x in v.split()}


def corpus():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) if r.random() < 0.8 else r.choice(["the", "of", "and", "der", "la"]) for _ in range(n))
    passage = text(25)
    rows = []
    for i in range(40):
        rows.append((i, text(r.randint(60, 200)) + (f"\n{passage}" if i % 5 == 0 else "")))
    for i in range(40, 50):
        base = rows[i - 40][1].split(" ")
        base[len(base) // 2] = "edited"
        rows.append((i, " ".join(base)))
    rows += [(50, "too short"), (51, "$$$ " * 100), (52, rows[3][1]), (53, None)]
    return rows


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 50:
        return False
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    twice = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    symbols, stops = len(re.findall(r"[#*$%&|<>]", text)), sum(x.lower().strip(".,;:!?\"'()") in STOPS for x in w)
    chars = sum(map(len, w)) / len(w)
    return 100 * len(twice) <= 50 * len(w) and symbols <= 0.2 * len(w) and stops >= 0.03 * len(w) and 2 <= chars <= 12


def near_free(rows):
    grams = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.lower().split() for _, t in rows)]
    df = Counter(g for c in grams for g in c)
    n = len(rows)
    vec = [{g: k * (1 + math.log((1 + n) / (1 + df[g]))) for g, k in c.items()} for c in grams]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            shared = sum(min(x, vec[j].get(g, 0)) for g, x in vec[i].items())
            if shared >= 0.8 * (sum(vec[i].values()) + sum(vec[j].values()) - shared):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [row for i, row in enumerate(rows) if group[i] == i]


def passage_free(rows):
    first, out = {}, []
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = t.encode()
        gone = {x for k in range(len(b) - 49) if first[b[k : k + 50]] < i for x in range(k, k + 50)}
        out.append((i, bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark, tmp_path):
    rows = corpus()
    full = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    expected = [r for r in rows if good(r[1])]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k in (1, 2):
            expected = (near_free, passage_free)[k - 1](expected)
        if k < 3:
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(expected)
        elif k == 3:
            mixed = Counter(r["doc_id"] for r in docs.collect())
            assert set(mixed) <= {i for i, _ in expected} and max(mixed.values()) <= 3
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = dict(expected)
    assert sum(r["length"] for r in docs.collect()) == sum(n * (1 + len(t.encode(text[i], add_special_tokens=False).ids)) for i, n in mixed.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_on_odd_tables(spark, docs, tmp_path):
    """Empty and all-null tables, repeated rows and extra columns go through every stage."""
    odd = [(None, None), (1, ""), (2, None), (3, "the of and " * 3)]
    for rows, kept in (([], [0, 0, 0, 0, 0]), (odd, [0, 2, 4, 0, 4])):
        for (_, stage), n in zip(corpus_pipeline.STAGES, kept, strict=True):
            out = stage(spark, docs(rows), str(tmp_path))
            if n is not None and not (rows and stage is corpus_pipeline.mix):
                assert out.count() == n, stage
            if stage is not corpus_pipeline.pack:
                assert out.columns == list(corpus_pipeline.COLUMNS)
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, docs(odd), "").collect()) == {None: 1, 1: 1, 2: 1, 3: 1}
