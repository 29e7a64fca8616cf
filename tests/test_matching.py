"""Fuzzy matching against brute force, and its cost on long texts."""


def test_fuzzy_match_equals_probing(spark):
    import random

    from spanlake.functions.matching import fuzzy_match
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 24)))
        k = rng.randint(0, 3)
        b = rng.choice(["", "a", "b"]) + a[k % 2:len(a) - k // 2] + rng.choice(["", "a", "b"])
        rows.append((a, b))

    def match(a, b):
        m = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        return bool(a) and bool(b) and 10 * m > 9 * len(a) and 10 * m > 9 * len(b)
    got = spark.createDataFrame(rows, "a string, b string").withColumn("m", fuzzy_match("a", "b")).collect()
    assert all(r["m"] == match(r["a"], r["b"]) for r in got) and any(r["m"] for r in got)


def test_periodic_and_wide_texts(spark):
    """Repeats of short periods, with edits near the ends and the middle: brute force agrees."""
    import random

    from spanlake.functions.matching import fuzzy_match
    rng = random.Random(1)

    def edit(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.choice([0, len(s), rng.randint(0, len(s)), rng.randint(0, max(1, len(s) // 10))])
            op = rng.random()
            if op < 0.4:
                s[k:k] = [rng.choice("abé\U0001F600")] * rng.randint(1, 3)
            elif op < 0.7:
                del s[max(0, k - rng.randint(1, 3)):k]
            elif s:
                s[k % len(s)] = rng.choice("ab")
        return "".join(s)

    def match(a, b):
        L = 9 * max(len(a), len(b)) // 10 + 1
        return 0 < L <= min(len(a), len(b)) and any(a[i:i + L] in b for i in range(len(a) - L + 1))

    rows = []
    for _ in range(3000):
        base = ("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) * 90)[:rng.randint(1, 80)]
        rows.append((edit(base), edit(base)))
    got = spark.createDataFrame(rows, "a string, b string").repartition(4).withColumn("m", fuzzy_match("a", "b")).collect()
    assert [r["m"] for r in got] == [match(r["a"], r["b"]) for r in got] and 500 < sum(r["m"] for r in got) < 2900


def test_long_pairs_take_less_than_a_second(spark):
    """100,000 characters whose middle occurs, with and without a match, random and periodic."""
    import random
    import time

    from spanlake.functions.matching import fuzzy_match
    rng = random.Random(2)
    mid = "".join(rng.choice("abcdefgh ") for _ in range(82_000))
    pairs = [("x" * 9000 + mid + "y" * 9000, "z" * 9000 + mid + "w" * 9000, False), ("x" * 9000 + mid + "y" * 9000, mid + "y" * 9000, True),
             ("b" + "a" * 99_998 + "c", "c" + "a" * 99_998 + "b", True), ("a" * 85_000 + "b" + "a" * 15_000, "a" * 84_000 + "c" + "a" * 16_000, False),
             ("a" * 55_000 + "b" + "a" * 45_000, "a" * 65_000 + "b" + "a" * 35_000, True), ("abcdefg" * 14_000, "zz" + "cdefgab" * 13_500, True)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").coalesce(1).cache()
    matched = df.select(fuzzy_match("a", "b").alias("m"))
    assert [r["m"] for r in matched.collect()] == [p[2] for p in pairs]
    start = time.perf_counter()
    matched.collect()
    assert time.perf_counter() - start < len(pairs)


def test_one_match_serves_all_metrics(spark):
    from spanlake.operators import aggregates as D
    from spanlake.plans import fixtures as fx
    log = fx.fx_cands(spark, "/root/testdata/sf0.001")
    sums = D.log_metrics(log)
    assert sorted(map(repr, D.metrics_pass_at_k(sums).collect())) == sorted(map(repr, D.pass_at_k(log).collect()))
    assert sorted(map(repr, D.metrics_any_match(sums).collect())) == sorted(map(repr, D.any_match_rate(log).select(
        "query", "total", "correct", "is_total", "any_match").collect()))
    empty = D.log_metrics(log.limit(0))
    assert sorted(map(repr, D.metrics_pass_at_k(empty).collect())) == sorted(map(repr, D.pass_at_k(log.limit(0)).collect()))
