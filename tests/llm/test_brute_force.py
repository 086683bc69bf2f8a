"""Queries without SQL against plain Python versions of what they define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyloom.llm.fingerprints import containment, distinct_shingles, edited_pairs, fingerprints, merged, resemblance
from tallyloom.llm.langid import language_id
from tallyloom.llm.licenses import PHRASES, TEMPLATES, license_scan
from tallyloom.llm.lmscore import PASSES, SMOOTH, score_documents, vocabulary
from tallyloom.llm.mixing import STEPS, class_numbers, mix_sources, mixed_rows, ranked_sources, sized, with_targets
from tallyloom.llm.packing import piece_table
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.suffixdedup import dedup_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
r = random.Random(3)
BAG = ["".join(r.choice("abcdeilnorstuéß") for _ in range(r.randint(1, 10))) for _ in range(150)]
SIGNS = ["", "", "", ",", ".", "!!", "###", "'s", "-x", "7"]


def prose(n, seed):
    g = random.Random(seed)
    return "".join(g.choice(BAG).title() + g.choice(SIGNS) + g.choice([" ", " ", "\n", "\t "]) for _ in range(n))


ROWS = [(i, prose(5 + 3 * (i % 40), i)) for i in range(90)] + [(90, ""), (91, None), (92, "x" * 200), (93, "日本語のテキスト" * 12), (94, "K \x1c a b c"), (95, "don't we'll <|endoftext|> Ünïcode_A1")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_lm(docs):
    out = {x["doc_id"]: x for x in score_documents(docs(ROWS), tokenizer_path("piece_bpe_32k.model")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in ROWS}
    words = {i: [w.encode() for w in WORD.findall(lower(t))] for i, t in ROWS}
    train, n_end = Counter(w for i, ws in words.items() if not held[i] for w in ws), sum(not h for h in held.values())
    n, v = sum(train.values()) + n_end, len(train) + 1
    pieces, lp = vocabulary(tokenizer_path("piece_bpe_32k.model"))
    longest = max(map(len, pieces))

    def segments(w):
        return [(i, j, w[i:j]) for j in range(1, len(w) + 1) for i in range(max(0, j - longest), j) if w[i:j] in prob]

    for _ in range(PASSES):
        prob, count = dict(zip(pieces, np.exp(lp), strict=True)), Counter()
        for word, c in train.items():
            for w in [b" " + word] if len(word) <= 64 else [word[k : k + 64] for k in range(0, len(word), 64)]:
                found = segments(w)
                a, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
                for i, j, p in found:
                    a[j] += a[i] * prob[p]
                for i, j, p in sorted(found, key=lambda x: -x[0]):
                    b[i] += prob[p] * b[j]
                for i, j, p in found:
                    count[p] += c * a[i] * prob[p] * b[j] / a[-1]
        total = sum(count.values()) + n_end + SMOOTH * (len(pieces) + 1)
        lp = np.array([math.log((count[p] + SMOOTH) / total) for p in pieces])
    prob = dict(zip(pieces, np.exp(lp), strict=True))

    def score(word):
        w = b" " + word
        a = [0.0] + [-math.inf] * len(w)
        for i, j, p in segments(w):
            a[j] = np.logaddexp(a[j], a[i] + math.log(prob[p]))
        return a[-1]

    for i, ws in words.items():
        x = out[i]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((n_end + 0.1) / (n + 0.1 * (v + 1)))
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(ws) + 1, sum(w in train for w in ws) + 1, n)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
        assert x["score"] == pytest.approx((sum(map(score, ws)) + math.log((n_end + SMOOTH) / total)) / math.log(10), rel=1e-5)


def test_ids_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {x["doc_id"]: x for x in piece_table(docs(ROWS), path, capacity=10**6).collect()}
    for i, text in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())), text
    other = tokenizer_path("byte_bpe_50k.json")  # cuts at no blank: goes through the library whole
    t = Tokenizer.from_file(other)
    for x in piece_table(docs(ROWS), other, capacity=10**6).collect():
        assert x["length"] == len(t.encode(dict(ROWS)[x["doc_id"]] or "", add_special_tokens=False).ids) + 1


def test_mix(docs):
    g = random.Random(8)
    rows = [(i, prose(g.choice([0, 1, 8, 40, 41, 42, 400]), i), ("en", g.choice(["a", "b", "B", "ü", None, "empty"]))) for i in range(500)]
    rows = [(i, "" if m[1] == "empty" else t, m) for i, t, m in rows] + [(7, "same row", ("en", "a"))] * 9
    d = docs(rows)
    out, draws = mix_sources(d).collect(), sized(d, "doc_id", "text", "source").collect()
    sources = sorted({m[1] for *_, m in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(WORD.findall(t)) for _, t, m in rows if m[1] == s) for s in sources}
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sources)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 3 * size[s]) for s in sources) < sum(size.values()) else (low, mid)
    want = Counter()
    for s in sources:
        target = min(high * weight[s], 3 * size[s])
        own = [x for x in draws if x["source"] == s]
        whole = min(3, int(target / size[s] + 1e-9)) if size[s] else 0
        by = {}
        for x in own:
            by.setdefault(math.floor(STEPS * math.log2(x["size"])) if x["size"] else -1, []).append(x)
        keys = list(by)
        numbers = class_numbers([(k, len(by[k]), sum(x["size"] for x in by[k])) for k in keys], target - whole * size[s])
        for k, n in zip(keys, numbers, strict=True):
            words = sum(x["size"] for x in by[k])

            def value(x):
                p = min(n * x["size"] / words, 1 - 1e-9)
                return x["u"] / (1 - x["u"]) / (p / (1 - p))

            chosen = sorted(by[k], key=value)[:n] if 0 < n < len(by[k]) else by[k][:n]
            for x in by[k]:
                want[x["doc_id"], x["size"]] += whole * x["size"]
            for x in chosen:
                want[x["doc_id"], x["size"]] += x["size"]
        got = [x for x in out if x["source"] == s]
        assert got[0]["target"] == pytest.approx(target, abs=1e-3) and got[0]["source_size"] == size[s]
        assert abs(sum(x["taken"] for x in got) - target) <= max(3, 0.01 * target) and all(x["taken"] <= 3 * x["size"] for x in got)
    have = Counter()
    for x in out:
        have[x["doc_id"], x["size"]] += x["taken"]
    assert have == want
    copies = Counter()
    for x in out:
        copies[x["doc_id"]] += x["copies"]
    assert Counter(x["doc_id"] for x in mixed_rows(d).collect()) == +copies
    again = docs(rows[::-1])
    assert sorted((x["doc_id"], x["taken"]) for x in mix_sources(again).collect()) == sorted((x["doc_id"], x["taken"]) for x in out)


def test_class_numbers():
    classes = [(k, 50, 50 * k) for k in range(1, 60)]
    for rest in (0, 3, 500, 40_000, sum(c[2] for c in classes)):
        n = class_numbers(classes, rest)
        assert all(0 <= x <= 50 for x in n) and abs(sum(x * c[0] for x, c in zip(n, classes, strict=True)) - rest) <= 1
    odds = [x / 50 for x in class_numbers(classes, 40_000)]
    assert odds[50] > odds[20] > odds[5]


def test_many_sources(spark):
    from pyspark.sql import functions as F

    s = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("source"), (F.col("id") % 7).alias("source_size"))
    got = with_targets(ranked_sources(s)).collect()
    assert [x["place"] for x in sorted(got, key=lambda x: x["source"])] == list(range(5000))
    assert sum(x["target"] for x in got) == pytest.approx(sum(x["source_size"] for x in got)) and all(x["target"] <= 3 * x["source_size"] + 1e-9 for x in got)


def test_licenses(docs):
    notice = dict(TEMPLATES)["mit-grant"]
    cut = notice.split()
    rows = [(i, f"{prose(20, i)} GNU General-Public  LICENSE {prose(9, -i)} cc/BY é mit license") for i in range(5)]
    rows += [(10, prose(30, 1) + notice.upper()), (11, " ".join(cut[:12] + ["zzz"] + cut[12:])), (12, " ".join(cut[::-1])), (13, "cc bKy mİt license K"), (14, None), (15, " ".join(cut[:8]))]
    out = {x["doc_id"]: x for x in license_scan(docs(rows)).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hits = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        x = out[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in hits}))
    assert all("mit-grant" in out[i]["labels"] for i in (10, 11)) and all("mit-grant" not in out[i]["labels"] for i in (12, 15))


def sketch(text):
    def h(*ws):
        x = 42
        for w in ws:
            x = xxhash.xxh64_intdigest(w.encode(), seed=x)
        return x >> 16

    w = WORD.findall(text or "")
    found = {h(*w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {h(" ".join(w))} if w else set()
    return sorted(found)[:64], len(found)


def test_fingerprints(docs, spark):
    rows = ROWS + [(None, prose(30, 500)), (None, prose(30, 501)), (None, None)]
    out = edited_pairs(docs(rows)).withColumn("near", resemblance(*cols("sketch", "edited_sketch"))).withColumn("next", resemblance(*cols("sketch", "next_sketch"))).collect()
    numbered = sorted((i, t or "") for i, t in rows if i is not None)
    follow = {i: t for (i, _), (_, t) in zip(numbered, numbered[1:], strict=False)}
    for x in out:
        assert x["sketch"] == sketch(x["text"])[0] and x["edited_sketch"] == sketch(x["edited"])[0]
        for other, near in ((x["edited_sketch"], x["near"]), (x["next_sketch"], x["next"])):
            both = sorted(set(x["sketch"]) | set(other))[:64]
            assert near == (sum(v in x["sketch"] and v in other for v in both) / len(both) if both else 1.0)
        if x["doc_id"] in follow:
            half = len(x["text"]) // 2
            assert x["edited"] == x["text"][: len(x["text"]) - half] + follow[x["doc_id"]][:half]
    assert len(out) == len(rows)


def cols(*names):
    from pyspark.sql import functions as F

    return [F.col(n) for n in names]


def test_sketch_estimates(docs, spark):
    a, b = prose(900, 1), prose(500, 2)
    d = {x["doc_id"]: x["sketch"] for x in fingerprints(docs([(1, a), (2, a + " " + b), (3, b), (4, "one two")])).collect()}
    t = spark.createDataFrame([(d[1], d[2], d[3], d[4])], "a array<long>, ab array<long>, b array<long>, few array<long>")
    x = t.select(merged(*cols("a", "b")).alias("m"), containment(*cols("a", "ab")).alias("within"), distinct_shingles(cols("ab")[0]).alias("n"), distinct_shingles(cols("few")[0]).alias("few")).first()
    union = sorted(set(sketch(a)[0]) | set(sketch(b)[0]))[:64]
    assert x["m"] == union and x["within"] > 0.8 and abs(x["n"] / sketch(a + " " + b)[1] - 1) < 0.4 and x["few"] == 1.0


def test_warc_files(spark, tmp_path):
    from tallyloom.llm.warc import capture_index, decided, merge_blocks, read_warc_files, save_archives, write_archives

    rows = [(i, f"http://www.h{i % 7}.org/p{i % 5}", f"<p>{i % 40}" * 60) for i in range(300)] + [(300, None, None), (301, "http://a.b", "é\x00"), (5, "http://www.h5.org/p0", "<p>5" * 60)]
    archives = write_archives(decided(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)))
    files = save_archives(archives, str(tmp_path / "out")).collect()
    assert len({f["archive"] for f in files}) == len(files)
    got = read_warc_files(spark, str(tmp_path / "out")).collect()
    assert sum(x["type"] == "warcinfo" for x in got) == len(files)
    response = [x for x in got if x["type"] == "response"]
    assert all(x["fields"]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(x["payload"]).hexdigest() for x in response)
    assert {bytes(x["payload"]).decode() for x in response} == {h or "" for *_, h in rows}
    index = capture_index(archives, block=7).collect()
    order = [(x["urlkey"], x["ts"], x["page_id"]) for x in index]
    assert order == sorted(order) and sorted(x["page_id"] for x in index) == sorted(i for i, *_ in rows)
    g = random.Random(4)
    for _ in range(20):
        blocks = [sorted(g.randint(0, 60) for _ in range(g.randint(1, 9))) for _ in range(g.randint(0, 12))]
        assert list(merge_blocks(sorted((b[0], b) for b in blocks), lambda x: x)) == sorted(x for b in blocks for x in b)


def test_hot_anchors(docs):
    parts = [prose(14, i) for i in range(9)]
    g = random.Random(6)
    rows = [(i, " ".join(g.choice(parts)[g.randint(0, 20) :] for _ in range(g.randint(1, 5)))) for i in range(60)]
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for got in dedup_passages(docs(rows).repartition(6), hot_groups=2).collect():
        b = rows[got["doc_id"]][1].encode()
        gone = {x for k in range(len(b) - 49) if first[b[k : k + 50]] < got["doc_id"] for x in range(k, k + 50)}
        assert bytes(got["kept"]) == bytes(c for k, c in enumerate(b) if k not in gone)


def test_language_distances(docs):
    g = random.Random(9)
    bag = {"xx": ["akoto", "belu", "onna", "tiri", "été"], "yy": ["schwun", "grepf", "druck", "zwist", "straße"]}
    rows = [(i, " ".join(g.choice(bag[lang] + bag["xx"][:2]) for _ in range(1 + i % 30)) + g.choice(["", " 12!", " Ab"]), (lang, None)) for i in range(60) for lang in [g.choice(["xx", "yy"])]]
    top = 40

    def grams(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        s = re.sub(" +", " ", s)
        return Counter(s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1) if s[k : k + n].strip(" ") and " " not in s[k : k + n][1:-1])

    def ranked(c):
        return [x for x, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(ch) if ch != " " else 1 for ch in x[0].ljust(3, "\0")]))][:top]

    profile = {}
    for lang in bag:
        total = sum((grams(t) for i, t, m in rows if m[0] == lang and zlib.crc32(str(i).encode()) % 4 != 2), Counter())
        profile[lang] = {x: k + 1 for k, x in enumerate(ranked(total))}
    out = {x["doc_id"]: x for x in language_id(docs(rows), top=top).collect()}
    for i, text, _ in rows:
        own = ranked(grams(text))
        gap = {lang: sum(min(abs(p[x] - k - 1), top) if x in p else top for k, x in enumerate(own)) for lang, p in profile.items()}
        best = min(sorted(gap), key=gap.get)
        assert (out[i]["lang_pred"], out[i]["score"]) == (best, pytest.approx(1 - gap[best] / (top * len(own)))), text
