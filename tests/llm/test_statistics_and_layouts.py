"""The randomness battery against plain Python, and pages without telling names."""

import math
import random
import time

from pyspark.sql import functions as F

from petrograph.llm import html_extract, secret_scan
from petrograph.llm.html_pages import labelled_pages


def log_tail(z):
    """log10 P(Z <= z)."""
    return math.log10(math.erfc(-z / math.sqrt(2)) / 2)


def test_tails_keep_their_relative_error(spark):
    zs = [i / 8 for i in range(-200, 65)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secret_scan.log10_below(F.col("z")).alias("p")).collect()
    assert all(abs(10 ** (r.p - log_tail(r.z)) - 1) < 2e-6 for r in got)


def battery(token):
    """(random_p, text_p) as log10, or None where no encoding fits."""
    import re
    for name, (rule, alphabet, uneven) in secret_scan.ENCODINGS.items():
        if re.search(rule, token):
            break
    else:
        return None
    bare = token.rstrip("=").replace("_", "/").replace("-", "+")
    bare = bare.lower() if name == "hex" else bare
    place = [alphabet.find(c) + 1 for c in bare]
    k, n = len(alphabet), len(bare)
    chi = sum(place.count(p) ** 2 for p in set(place)) * k / n - n
    wilson = ((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    upper = [p > k / 2 for p in place]
    ones, turns = sum(upper), sum(a != b for a, b in zip(upper, upper[1:], strict=False))
    mean = 2 * ones * (n - ones) / n
    runs = -abs(turns - mean) / math.sqrt(max(mean * (mean - 1) / (n - 1), 1e-9))
    middle = sum(place) / n
    off = [p - middle for p in place]
    serial = -abs(sum(a * b for a, b in zip(off, off[1:], strict=False)) / max(sum(x * x for x in off), 1e-9)) * math.sqrt(n)
    least = min(log_tail(-wilson), log_tail(min(runs, serial)) + math.log10(2))
    shift = n * uneven
    return min(0.0, least + math.log10(3)), log_tail((chi - (k - 1 + shift)) / math.sqrt(2 * (k - 1 + 2 * shift)))


def test_battery_against_plain_python(spark):
    rng = random.Random(6)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "abcdefghijklmnopqrstuvwxyz"]
    tokens = ["".join(rng.choice(k) for _ in range(rng.randint(20, 90))) + "=" * rng.randint(0, 2) for k in kinds for _ in range(12)]
    tokens += ["a1" * 20, "0" * 30 + "f", "Aa0" * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("stop"),
                           F.col("t").alias("value")))
    got = {r.i: r.x for r in rows.select("i", secret_scan.tested(one).alias("x")).collect()}
    for i, t in enumerate(tokens):
        want = battery(t)
        if want is None:
            assert got[i] == []
        else:
            assert abs(got[i][0].random_p - want[0]) < 1e-5 and abs(got[i][0].text_p - want[1]) < 1e-5, t


def test_random_tokens_are_rarely_called_uneven(spark):
    """Under the null each test's p-value lies below 0.001 / 3 for about as many tokens."""
    rng = random.Random(9)
    alphabet = secret_scan.ENCODINGS["base64"][1]
    rows = spark.createDataFrame([("aA0" + "".join(rng.choice(alphabet) for _ in range(61)),) for _ in range(3000)], "t string")
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("stop"),
                           F.col("t").alias("value")))
    low = rows.select(F.get(secret_scan.tested(one), F.lit(0)).alias("x")).filter(F.col("x.random_p") < -2).count()
    assert low < 3000 * 0.02


S = "One two three four five six seven eight nine ten. Another sentence follows here with words."
KEPT = f"Head line\n{S}\n{S}"


def test_pages_without_telling_names():
    weights = html_extract.train(labelled_pages())
    story = f"<h1>Head line</h1><p>{S}</p><p>{S}</p>"
    for page in (f"<body>{story}</body>", f"<body><div class='wrap'><div class='col'>{story}</div></div>",
                 f"<body><table><tr><td>{story}</td></tr></table>",
                 f"<body><article>{story}<div class='remarks'><p>{S}</p><p>short one</p></div></article>",
                 f"<body><main><h1>Head line</h1><p>{S}</p><form><p>Your name please</p><input></form><p>{S}</p></main>"):
        assert html_extract.main_text(page, weights) == KEPT, page


def test_deep_pages_take_time_in_proportion():
    weights = html_extract.train(labelled_pages(), rounds=5)
    for tail in ("<p>deep", "<li>a<li>b<table><tr><td>c<td>d"):
        begin = time.process_time()
        html_extract.main_text("<div>" * 20_000 + tail, weights)
        assert time.process_time() - begin < 2.5
