"""Operators against plain Python on small tables, and round trips."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spanlake.llm import ann, decontaminate, jaccard, langid, maxent, mixing, pii, suffixes, urlfilter, warc
from spanlake.llm.components import components
from tests.conftest import SF_SMALL


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_repeats(spark):
    random.seed(3)
    pool = ["".join(random.choice("ab cé") for _ in range(random.randint(10, 160))) for _ in range(30)]
    rows = [(i // 2 if i % 17 == 0 else i, "".join(random.choice([*pool, "x" * 70, "ab" * 40, "-"]) for _ in range(random.randint(0, 6))))
            for i in range(150)]
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], i), i)
    want = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)),
                     hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_repeats_around_hot_grams(spark):
    # a passage with other edges in every document: no bucket may get all its contexts
    rng = random.Random(8)
    passage = "this passage is shared by every document of the table, word by word"
    noise = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60)))
    rows = [(i, f"{noise()} {passage} {noise()}" + " " * (i % 70) + noise()[:4]) for i in range(400)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k:k + 50], i)
    want = []
    for i, t in rows:
        gone = {p for k in range(len(t) - 49) if first[t[k:k + 50]] < i for p in range(k, k + 50)}
        want.append((i, len(gone), hashlib.sha256("".join(c for p, c in enumerate(t) if p not in gone).encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (0, 16, suffixes.HOT):
        got = suffixes.remove_repeats(docs, hot=hot)
        assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want
    most = lambda hot: _most_contexts(rows, hot)
    assert most(suffixes.HOT) > 200 and most(16) <= 16


def _most_contexts(rows, hot, n=4):
    """The most contexts that one gram brings to a bucket."""
    packed = [b.to_pylist()[0] for b in suffixes._pack([pa.RecordBatch.from_pydict({"d": [i for i, _ in rows], "t": [t for _, t in rows]})])]
    sent = pa.Table.from_batches(suffixes._send_grams(n)([pa.RecordBatch.from_pylist(packed)])).to_pylist()
    replies = [r for k in range(n) for r in suffixes._find_shared(hot)(pa.Table.from_pylist([x for x in sent if x["bucket"] == k])).to_pylist()]
    contexts = suffixes._send_contexts(n)(pa.Table.from_pylist(packed), pa.Table.from_pylist(replies)).to_pylist()
    by = collections.Counter(g for r in contexts if r["shapes"] is not None for g in np.frombuffer(r["grams"], np.uint64).tolist())
    return max(by.values(), default=0)


def test_hot_strings_with_one_hash():
    text = [b"a" * 50, b"b" * 50, b"a" * 50, b"b" * 49 + b"c"]
    row = lambda block, own, ids: {"block": block, "bucket": 0, "grams": np.full(len(own), 7, np.uint64).tobytes(), "ids": np.array(ids).tobytes(),
                                   "shapes": None, "text": zstandard.compress(b"".join(text[k] for k in own))}
    t = pa.Table.from_pylist([row("x", [0, 1], [5, 2]), row("y", [2, 3], [6, 9])])
    t = t.set_column(t.schema.get_field_index("shapes"), "shapes", pa.nulls(2, pa.binary()))
    assert [np.unpackbits(np.frombuffer(a, np.uint8), count=2).tolist() for a in suffixes._judge_bucket(t)["answer"].to_pylist()] == [[0, 0], [1, 0]]


def test_equal_groups_match_sorting():
    rng = np.random.default_rng(1)
    m = rng.integers(97, 99, (6000, 50)).astype(np.uint8)
    m[:, :40] = 97
    got = sorted(sorted(g.tolist()) for g in suffixes.equal_groups(m))
    by = collections.defaultdict(list)
    for k, r in enumerate(m):
        by[r.tobytes()].append(k)
    assert got == sorted(g for g in by.values() if len(g) > 1)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = langid.predict(docs.withColumn("held", langid.held_out()), langid.fit_documents(docs)).where("held")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0


def test_language_grams_over_chunks(monkeypatch):
    text = "Der die das, und: für ÄÖ " * 60
    whole = dict(zip(*(x.tolist() for x in langid.grams(text))))
    monkeypatch.setattr(langid, "CHUNK_CHARS", 37)
    assert dict(zip(*(x.tolist() for x in langid.grams(text)))) == whole


def test_nearest_recall():
    x = np.random.default_rng(0).normal(size=(1500, 24)) * np.random.default_rng(1).uniform(0.5, 2, (1500, 1))
    graph, entry = ann.build(x)
    found, _ = ann.search(x, graph, entry, x[::10], 20)
    true = np.argsort(-(x[::10] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, true)]) >= 0.95


def test_nearest_over_many_shards(spark):
    """Recall against brute force when every query is answered by many shards."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    got = collections.defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, shard=32, query_block=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = n = 0
    for q in (k for k in x if k % 20 == 0):
        true = sorted((-float(x[q] @ v), k) for k, v in x.items() if k != q)[:20]
        hit, n = hit + len({k for _, k in true} & {k for k, _ in got[q]}), n + len(true)
        assert all(s == pytest.approx(float(x[q] @ x[k])) for k, s in got[q]) and len(got[q]) == 20
    assert hit >= 0.95 * n


def plain_profile(texts, top):
    """The most frequent n-grams of letters, ties by code points."""
    count = collections.Counter()
    for t in texts:
        t = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
        for i in range(len(t)):
            for g in (t[i:i + n] for n in (1, 2, 3) if i + n <= len(t)):
                if len(g) == 1 and g != " " or len(g) == 2 and g != "  " or len(g) == 3 and g[1] != " ":
                    count[g] += 1
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], key(g)))[:top]


def plain_language(profiles, text):
    own = plain_profile([text], langid.TOP)
    if not own or not profiles:
        return "und", 0.0
    away = {}
    for lang in sorted(profiles):
        place = {g: k for k, g in enumerate(profiles[lang])}
        away[lang] = sum(abs(place[g] - k) if g in place else langid.SIZE for k, g in enumerate(own))
    best = min(sorted(away), key=away.get)
    return best, max(0.0, 1 - away[best] / (len(own) * langid.SIZE))


def test_language_equals_plain(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    learn = collections.defaultdict(set)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            learn[r["lang"]].add(r["text"])
    assert max(map(len, learn.values())) <= langid.PER_LANG
    profiles = {k: plain_profile(v, langid.SIZE) for k, v in learn.items()}
    for r in langid.op2_language(spark, SF_SMALL).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        lang, score = plain_language(profiles, text)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score), r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def plain_shingles(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_plain(spark, tmp_path):
    """``run`` against plain versions of its stages on a small corpus."""
    import corpus_pipeline
    random.seed(6)
    pools = {"en": "the cat sat with that old man while they were there and then went home through this wood".split(),
             "de": "der die das und ist nicht mit einem auch schon wir haben eine kleine stadt durch den wald".split(),
             "fr": "le la les et est dans une ville avec nous avons petite maison pour les enfants toujours bien".split()}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        rows.append([i, " ".join(random.choice(pools[lang]) for _ in range(random.randint(12, 40))), lang, f"s{i % 4}"])
    rows[40][1] = rows[7][1]
    rows[50][1] = rows[8][1] + " extra"
    rows[12][1] += " write to ann@example.org or +1 (212) 555-0147"
    item = "one two three four five six seven eight nine ten eleven"
    rows[21][1] += f" {item}"
    rows += [[90, None, None, "s0"], [91, "12 34 !!", None, "s1"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    learn = collections.defaultdict(set)
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 and lang and text:
            learn[lang].add(text)
    profiles = {k: plain_profile(v, langid.SIZE) for k, v in learn.items()}
    kept = [r for r in rows if (p := plain_language(profiles, r[1]))[0] != "und" and p[1] >= corpus_pipeline.MIN_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {90, 91}
    sets = {r[0]: plain_shingles(r[1]) for r in kept}
    label = {r[0]: r[0] for r in kept}
    for a in sorted(label):
        for b in sorted(label):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low = min(label[a], label[b])
                label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
    kept = [r for r in kept if label[r[0]] == r[0]]
    words = tuple(item.split())
    kept = [r for r in kept if not any(w in " ".join(r[1].split()) for w in (" ".join(words[:10]), " ".join(words[1:])))]
    want = {r[0]: r[1].replace("ann@example.org", "<EMAIL>").replace("+1 (212) 555-0147", "<PHONE>") for r in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {40, 50, 21}.isdisjoint(want) and {r["doc_id"] for r in got} <= set(want)
    assert all(r["text"] == want[r["doc_id"]] and r["size"] == len(r["text"].split()) and r["n_chars"] == len(r["text"]) for r in got)
    # the mix: targets by weight 1, 2, 3, 1 (capped at three times a source), met within a document
    size = collections.Counter()
    for r in kept:
        size[r[3]] += len(want[r[0]].split())
    taken, copies = collections.Counter(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"]
        copies[r["doc_id"]] += 1
        assert r["source_size"] == size[r["source"]]
    weight = dict(zip(sorted(size), (1, 2, 3, 1)))
    assert max(copies.values()) <= 3 and all(3 * size[s] > sum(size.values()) * weight[s] / 7 for s in size)
    for s in size:
        assert abs(taken[s] - sum(size.values()) * weight[s] / 7) <= 45


def test_decontamination(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()] + [(900, "the of"), (901, "the of")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k:k + 10])].add(str(i))
    want = {}
    for d, t in texts(spark).items():
        w, hit, ids = word.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    ids |= own
        want[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    got = decontaminate.contamination(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert any(x[4] for x in want.values())


def test_maxent_counts(spark):
    got = maxent.op6_maxent(spark, SF_SMALL).collect()
    toks = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for d, t in texts(spark).items()}
    c = collections.Counter(w for d, t in toks.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r["score"]) and r["score"] < 0


def plain_maxent(rows, train):
    """{doc: log10 probability} of the class-factored model, position by position."""
    import xxhash
    full = (1 << 64) - 1

    def mix(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & full
        return h ^ (h >> 32)

    words = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() + [""] for d, t in rows}
    h = {w: xxhash.xxh3_64_intdigest(w.encode()) for ws in words.values() for w in ws}
    count = collections.Counter(w for d in train for w in words[d])
    kind = {w: maxent.ending(w.encode()) for w in h}
    own = sorted((w for w in h if count[w]), key=lambda w: (-count[w], h[w]))[:maxent.OWN]
    size = {c: [sum(count[w] for w in h if kind[w] == c and w not in own), sum(count[w] > 0 for w in h if kind[w] == c and w not in own)]
            for c in range(maxent.CLASSES)}
    kind |= {w: k for k, w in enumerate(sorted(own, key=h.get))}
    n = maxent.SLOTS - 1

    def slots(ws, i):
        one = h[ws[i - 1]] if i else int(maxent._START)
        two = h[ws[i - 2]] if i > 1 else int(maxent._START)
        return [0, 1 + mix(one) % n, 1 + mix((mix(one) + two) & full) % n, 1 + mix(two ^ 0xA5A5A5A5A5A5A5A5) % n]

    seen = collections.defaultdict(lambda: np.zeros(maxent.CLASSES))
    places = [(slots(words[d], i), kind[words[d][i]]) for d in train for i in range(len(words[d]))]
    for f, y in places:
        for s in f:
            seen[s][y] += 1
    share = (seen[0] + 1) / (seen[0].sum() + maxent.CLASSES)
    weight = {s: maxent.START * np.log((x + maxent.PRIOR * share) / (x.sum() + maxent.PRIOR) / share) for s, x in seen.items()}
    weight[0] = np.log(share)

    def chances(f):
        z = sum(weight.get(s, np.zeros(maxent.CLASSES)) for s in f)
        e = np.exp(z - z.max())
        return e / e.sum()

    for _ in range(maxent.ROUNDS):
        hoped = collections.defaultdict(lambda: np.zeros(maxent.CLASSES))
        for f, _ in places:
            p = chances(f)
            for s in f:
                hoped[s] += p
        weight = {s: w + maxent.RATE * (seen[s] - hoped[s]) / (np.maximum(seen[s], hoped[s]) + maxent.PRIOR * share) for s, w in weight.items()}
    out = {}
    for d, ws in words.items():
        out[d] = 0.0
        for i, w in enumerate(ws):
            out[d] += math.log10(chances(slots(ws, i))[kind[w]])
            if kind[w] >= maxent.OWN:
                out[d] += math.log10((count[w] + 1) / (sum(size[kind[w]]) + 1))
    return out


def test_maxent_score_equals_plain(spark):
    random.seed(2)
    pool = ["the", "cat", "sat", "on", "mat.", "Haus", "im", "Garten,", "été", "x1", "mat", "dans", "la", "ville", "é", "--", "und", "die",
            "der", "old", "new", "big", "one", "two", "three", "four", "five", "six", "seven", "eight"]
    rows = [(i, " ".join(random.choice(pool) for _ in range(random.randint(0, 14)))) for i in range(40)] + [(40, None), (41, "new words only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_maxent(rows, [d for d, _ in rows if d % 4])
    for parts in (1, 5):
        got = maxent.score(docs.repartition(parts), F.col("doc_id") % 4 == 0, F.col("doc_id") % 4 != 0).collect()
        assert {r["doc_id"] for r in got} == set(want)
        assert all(r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-4) for r in got)


def test_maxent_beats_its_base(spark):
    """Held-out texts score better than under unigrams, alike in any layout."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = [{r["doc_id"]: r for r in maxent.score(docs.repartition(p), held, ~held).collect()} for p in (1, 6)]
    out = [r for r in got[0].values() if r["held_out"]]
    assert sum(r["score"] for r in out) / sum(r["n_tokens"] for r in out) > sum(r["base_score"] for r in out) / sum(r["n_tokens"] for r in out) + 0.1
    assert all(abs(r["score"] - got[1][d]["score"]) < 1e-5 * r["n_tokens"] for d, r in got[0].items())


def luhn(d):
    return sum(int(x) if i % 2 == 0 else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][int(x)] for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(found))


def test_personal_data(spark, tmp_path):
    random.seed(5)
    parts = ["a@b.c", "x.y+z@h-1.example.com", "@", ".", "-", "+", "1.2.3.4", "300.1.2.3", "4111111111111111", "4111 1111-1111 1111",
             "+1 (777) 555-7427", " ", "é𝄞", "12", "a", "%x@y.z", "00255.1.1.01", "5", "(", "_", "foo (at) bar.com"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 25)))) for i in range(800)] + [(900, None), (901, "1" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = dict(rows)
    for r in pii.op7_pii(spark, str(tmp_path)).collect():
        want = base_spans(by[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    merged = [(i, "call +1 (777) 555-7427 today") for i in range(400)] + [(1000, "see +1 (438) 555-5817 4387393285946913 42 now")]
    out = pii.redact(spark.createDataFrame(merged, "doc_id long, text string"))
    assert out.where("doc_id = 0").head()["text"] == "call <PHONE> today"
    assert "<PHONE>" in out.where("doc_id = 1000").head()["text"]


def test_personal_data_beside_base(spark):
    # rates of base spans decide nothing: proposals that only the model can add prevail, or base has none at all
    bare = ["ring 555-123-4567 now", "pay 378282246310005 or", "ask jo.doe (at) mail.example.com or", "ask jo [at] example [dot] com or",
            "Tel.: 030 1234567 ab", "Tél : 01 23 45 67 89 ab", "phone 020 7946 0958 ab"]
    none = ["at 1700000000000 ms", "call 01.02.2024 ab", "no 4111111111111112 ab", "in 030 1234567 ab"]
    plus = ["+1 (017) 555-7713", "4111111111111111", "a@example.com"]
    for base in ([], plus * 3, plus * 300):
        rows = [(i, " " * (i % 7) + t) for i, t in enumerate((bare + none) * 30 + base)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = {r["doc_id"]: r["text"].strip() for r in pii.redact(docs).collect()}
        for k, text in enumerate(bare):
            assert re.search("<(PHONE|CARD|EMAIL)>", out[k]) and not re.search("[0-9]|at[)\\]]|com", out[k]), (text, out[k])
        assert [out[len(bare) + k] for k in range(len(none))] == none


def test_personal_data_of_small_corpora(spark):
    # no number of spans is needed, and the caller's columns stay as they are
    rows = [(1, "Please call 555-123-4567 today", "mail a@b.org now", 7), (2, "call 555-987-6543", None, 8)]
    names = ["t", "num", "g0", "own", "cands", "base", "more", "added", "spans", "doc", "new", "n", "a.b", "_all", "_cands"]
    docs = spark.createDataFrame([(i, x, *[t] * len(names), k) for i, x, t, k in rows],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names) + ", n_chars int")
    out = pii.redact(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and out.schema == docs.schema
    assert (got[1]["text"], got[2]["text"]) == ("Please call <PHONE> today", "call <PHONE>")
    assert all(got[1][c] == "mail a@b.org now" for c in names) and got[1]["n_chars"] == len("Please call <PHONE> today")
    assert pii.redact(docs.where("doc_id = 2")).first()["text"] == "call <PHONE>"


def plain_boost(rows, rounds=pii.ROUNDS):
    """Scores of feature sets by depth-2 trees, in plain Python: (bits, label) -> function."""
    start = math.log((sum(y for _, y in rows) + 0.5) / (sum(1 - y for _, y in rows) + 0.5))
    trees, score = [], [start] * len(rows)

    def leaf(idx):
        g = sum(rows[i][1] - p[i] for i in idx)
        h = sum(p[i] * (1 - p[i]) for i in idx)
        return pii.RATE * g / (h + 1), g * g / (h + 1)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in score]
        best = None
        for f in range(len(pii.FEATURES)):
            sides, gain = [], 0.0
            for on in (0, 1):
                idx = [i for i, (b, _) in enumerate(rows) if (b >> f & 1) == on]
                top = None
                for g in range(len(pii.FEATURES)):
                    two = [leaf([i for i in idx if (rows[i][0] >> g & 1) == v]) for v in (0, 1)]
                    if top is None or two[0][1] + two[1][1] > top[1] + 1e-12:
                        top = ((g, two[0][0], two[1][0]), two[0][1] + two[1][1])
                sides.append(top[0])
                gain += top[1]
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, sides)
        trees.append(best[1:])
        score = [x + (lambda s: s[1 + (b >> s[0] & 1)])(trees[-1][1][b >> trees[-1][0] & 1]) for x, (b, _) in zip(score, rows)]
    return lambda bits: start + sum((lambda s: s[1 + (bits >> s[0] & 1)])(t[1][bits >> t[0] & 1]) for t in trees)


def test_personal_data_model(spark):
    rows = pii.sample(spark)
    model = pii.fit(spark)
    bits = np.array(sorted({r[4] for r in rows}), np.int64)
    plain = plain_boost([(r[4], float(r[3])) for r in rows], rounds=6)
    short = pii.boost(np.array([r[4] for r in rows]), np.array([r[3] for r in rows], float), np.array([not r[3] for r in rows], float), rounds=6)
    assert np.allclose(short.scores(bits), [plain(int(b)) for b in bits], atol=1e-6)
    assert all(math.isfinite(x) for x in model.thresholds)
    # labels are no function of the features alone that the trees just repeat: the sentences decide
    right = [(model.scores(np.array([r[4]]))[0] >= model.thresholds[r[1]]) == r[3] for r in rows]
    assert sum(right) >= 0.95 * len(rows)


def test_added_spans_equal_plain(spark):
    """Which proposals are added, from the proposals and the model, in plain Python."""
    random.seed(11)
    parts = ["call 555-123-4567", "Tel. 030 1234567", "jo (at) ex.com", "378282246310005", "4111111111111112", "+1 212 555 0147", "1700000000000",
             "a@b.org", "300.1.2.3", "x", "(212) 555-0147 0711 555123", "phone 01 23 45 67 89 555-123-4567"]
    docs = spark.createDataFrame([(i, " ".join(random.choice(parts) for _ in range(random.randint(0, 7)))) for i in range(300)], "doc_id long, text string")
    model = pii.fit(spark)
    cands = pii.with_candidates(docs)
    got = {r["doc"]["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.with_spans(cands, model).collect()}
    some = 0
    for r in cands.collect():
        base = {(c["kind"], c["s"], c["e"]) for c in r["cands"] if c["base"]}
        more = [(-model.scores(np.array([c["bits"]]))[0], c["s"], -c["e"], c["kind"]) for c in r["cands"] if not c["base"]]
        more = [m for m in more if -m[0] >= model.thresholds[m[3]] and not any(s < -m[2] and m[1] < e for _, s, e in base)]
        added = {(k, s, -e) for w, s, e, k in more if not any(o < (w, s, e, k) and o[1] < -e and s < -o[2] for o in more)}
        assert got[r["doc"]["doc_id"]] == sorted(base | added)
        some += bool(added)
    assert some > 50


def test_urls_that_part_deep(spark):
    deep = "/topic/a/b/c/d"
    rules = [("block", "h.com", f"/2024/05/12{deep}/spam/"), ("allow", "h.com", f"/2024/05/12{deep}/news/")]
    urls = [f"http://h.com/{day}{deep}/{kind}/x{i}" for day in ("2024/05/12", "2025/01/02") for kind in ("spam", "news") for i in range(60)]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://h.com/1/2/3/topic/a/z"])), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, rules).collect()}
    assert [got[k]["verdict"] for k in range(240)] == (["block"] * 60 + ["allow"] * 60) * 2
    assert got[120]["template"].endswith("/d/spam/**") and got[240]["verdict"] == "allow" and len(got) == 241


def plain_templates(rows, depth):
    """{(host, segments): (template, purity)} of the path tree, list by list."""
    lists = collections.defaultdict(lambda: [0, 0, 0])
    for host, segs, label in rows:
        x = lists[host, segs]
        x[0], x[1], x[2] = x[0] + 1, x[1] + (label is not None), x[2] + (label or 0)
    lab, blk = (sum(x[k] for x in lists.values()) for k in (1, 2))
    prior = blk / lab if lab else 0.0
    smooth = lambda b, n, up: (b + urlfilter.SMOOTH * up) / (n + urlfilter.SMOOTH)

    def sums(of):
        out = collections.defaultdict(lambda: [0, 0, 0])
        for key, x in of:
            out[key] = [a + b for a, b in zip(out[key], x)]
        return out

    hosts = sums((h, x) for (h, _), x in lists.items())
    state = {k: ("", True, False, smooth(hosts[k[0]][2], hosts[k[0]][1], prior)) for k in lists}
    level = 0
    while True:
        here = [k for k, v in state.items() if v[1] and len(k[1]) > level]
        if level > depth and not here:
            return {k: (v[0], v[3]) for k, v in state.items()}
        seg = {k: k[1][level] if level < depth or level == 0 or state[k][2] else "**" for k in here}
        kids = sums(((k[0], state[k][0], seg[k]), lists[k]) for k in here)
        up = {(k[0], state[k][0]): state[k][3] for k in here}
        parents, n_kids = sums((k[:2], x) for k, x in kids.items()), collections.Counter(k[:2] for k in kids)
        name = {}
        for (h, node, sg), (n, la, bl) in kids.items():
            total = parents[h, node]
            rate = (total[2] + 0.5) / (total[1] + 1)
            alike = n_kids[h, node] > 1 and la > 0 and abs(bl / la - rate) / math.sqrt(rate * (1 - rate) / la) < urlfilter.APART
            rare = n_kids[h, node] > urlfilter.MANY and n <= urlfilter.RARE * total[0]
            name[h, node, sg] = "*" if rare or alike else sg
        merged = sums(((h, node, name[h, node, sg]), x) for (h, node, sg), x in kids.items())
        new = {}
        for k, (node, _, mixed, purity) in state.items():
            if k in seg:
                as_ = name[k[0], node, seg[k]]
                _, la, bl = merged[k[0], node, as_]
                new[k] = (f"{node}/{as_}", level < depth or mixed or level == 0, 0 < bl < la, smooth(bl, la, up[k[0], node]))
            else:
                new[k] = (node, level < depth or level == 0, False, purity)
        state, level = new, level + 1


def test_url_tree_equals_plain(spark):
    random.seed(9)
    rows = []
    for _ in range(4000):
        host = random.choice(["a.org", "b.com", ""])
        segs = [random.choice(["blog", "shop", "spam"]), random.choice(["x", "y", f"id{random.randint(0, 400)}"])][:random.randint(0, 2)]
        if len(segs) == 2:
            segs += [random.choice("pqr") for _ in range(random.randint(0, 5))]
        bad = "spam" in segs or segs[-2:] == ["p", "q"]
        label = None if random.random() < 0.4 else int(bad if random.random() < 0.97 else not bad)
        rows.append((host, tuple(segs), label))
    df = spark.createDataFrame([(h, list(s), x) for h, s, x in rows], "host string, segs array<string>, label int").repartition(5)
    for depth in (2, 4):
        want = plain_templates(rows, depth)
        got = {(r["host"], tuple(r["segs"])): (r["template"], r["purity"]) for r in urlfilter.templates(df, depth).collect()}
        assert set(got) == set(want) and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(v[1] == pytest.approx(want[k][1]) for k, v in got.items())
        assert any(t.endswith("**") for t, _ in want.values()) and any("/*" in t for t, _ in want.values())


def test_warc_unreadable_headers():
    good = warc.record(1, "http://a/", b"abc", warc.digest(b"abc"), None, False)
    head = good.partition(b"\r\n\r\n")[0]
    length = next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
    for bad in (good.replace(length, b"Content-Length: twelve", 1), good.replace(b"http://a/", b"http://\xff/", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_warc_rejects_damage():
    data = warc.member(warc.record(1, "http://a/", b"abc" * 50, warc.digest(b"abc" * 50), None, False))
    assert warc.parse(next(warc.members(io.BytesIO(data * 2))))[2] == b"abc" * 50
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(data[:-9])))
    plain = warc.record(1, None, b"abc", warc.digest(b"abc"), None, False)
    with pytest.raises(warc.WarcError):
        warc.parse(plain.replace(b"abc", b"abd"))


def test_jaccard(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(12):
            t = base[:]
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    s = {i: shingles(t) for i, t in rows}
    links, par = collections.Counter(), {i: i for i in s}
    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for i in s:
        for j in range(i):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(i, find(i), links[i]) for i in s}


def test_jaccard_of_large_buckets(spark):
    """Hundreds of variants of one text, most just under or over the threshold, share buckets of
    over ``SMALL`` nodes: links that are found are right, and over 98 % are found."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 420):
        t = base[:]
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(len(t))] = f"v{rng.randint(0, 300)}"
        rows.append((i, " ".join(t)))
    s = {i: plain_shingles(t) for i, t in rows}
    links = {i: sum(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in s) for i in s}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 420 > jaccard.SMALL and all(n <= links[i] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.98 * sum(links.values())
    linked = [i for i, n in links.items() if n]
    assert sum(got[i][1] > 0 for i in linked) >= 0.98 * len(linked)
    assert all(c == i for i, (c, n) in got.items() if not n) and all(c < i for i, (c, n) in got.items() if n and c != i)


def test_verify_over_blocks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(60) if k != i)) for i in range(70)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    s = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: sum(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in s) for i in s}
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100), (103, 100)}


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ["b", "a", None, "c"][min(i % 9, 3)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, group=32).toPandas()
    assert len(got) == 3000 and got["taken"].equals(mixing.mix(docs.repartition(7), group=32).toPandas().set_index("doc_id").loc[got["doc_id"], "taken"].reset_index(drop=True))
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), own=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 60).all() and by["target"].sum() == pytest.approx(by["own"].sum())
    assert (by["target"] <= 3 * by["own"] + 1e-6).all() and (got["copies"] <= 3).all()
    # a, b, c, null weigh 1, 2, 3, 1; a, b and null have a ninth each
    total, w = by["own"].sum(), {"a": 1, "b": 2, "c": 3, None: 1}
    size = {(None if k != k else k): v for k, v in by["own"].items()}
    target = {}
    free, left = dict(w), total
    while True:
        level = left / sum(free.values())
        full = [k for k in free if level * free[k] > 3 * size[k]]
        if not full:
            break
        for k in full:
            target[k] = 3 * size[k]
            left -= target[k]
            del free[k]
    target |= {k: level * v for k, v in free.items()}
    for k, v in by["target"].items():
        assert v == pytest.approx(target[None if k != k else k])


def test_mixing_without_ids_and_with_clashing_names(spark):
    rows = [(None, "w " * 10, s) for s in "abc" for _ in range(1000)]
    names = ["n", "p", "s", "whole", "extra", "row", "doc", "w", "mass", "m", "h", "due", "e_id", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"mine {c}") for c in names if "." not in c})
    docs = docs.withColumn("a.b", F.lit("mine a.b"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert len(got) == 3000 and all(r[c] == f"mine {c}" for r in got[::100] for c in names)
    for s, target in zip("abc", (5_000, 10_000, 15_000)):
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target) and abs(sum(r["taken"] for r in own) - target) <= 10
    assert mixing.mix(docs, columns=["doc_id"]).columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
