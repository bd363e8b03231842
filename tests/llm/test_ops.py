"""The training-data operators against plain versions, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain.llm import chat, common, decontam, exact_dedup, html, line_dedup, mixing, ngram_join, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=True):
    """rows: (doc_id, text[, source]). Extra columns clash with names that the operators use inside."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], DOC)
    if extra:
        for c in ("id", "key", "size", "target", "n", "grp", "token", "words", "spans", "kept", "d", "of", "tie", "rep", "label"):
            df = df.withColumn(c, F.lit(1))
    return df


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def random_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- text kernels


def test_word_hashes_agree_with_words():
    rng = random.Random(0)
    texts = ["", " ", "A b\tC", "é É x", "a" * 5000, *(" ".join(random_words(rng, rng.randrange(60))) for _ in range(30)), None]
    h, bounds = common.word_hashes(common.pa.array(texts))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = {}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").translate(lower))
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, x in zip(words, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_scratch_goes_and_what_is_saved_outside_stays(spark):
    kept = common.saved(spark.range(3), "kept")
    with common.scratch(spark):
        inside = common.saved(spark.range(4), "inside")
        path = inside.inputFiles()[0]
        assert inside.count() == 4
    assert kept.count() == 3
    import os

    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))


# --- 1 exact dedup


def test_fingerprints_compose():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = exact_dedup.fingerprints(data, np.array([0, 5000]))[0]
    for cut in (0, 1, 1024, 1025, 4999, 5000):
        a, b = exact_dedup.fingerprints(data, np.array([0, cut, 5000]))
        assert exact_dedup.combine(a, b) == whole


def plain_dedup(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    keep = {k: min(v)[3] for k, v in groups.items()}
    return [(i, keep[k := re.sub(r"[\x20\x09-\x0D]", "", t or "")], len(groups[k]), i == keep[k], hashlib.sha256(k.encode()).hexdigest()) for i, t, *_ in rows]


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (7, "é x"), (8, "éx"), (9, "x" * 5000), (10, "x" * 2500 + " " + "x" * 2500), (None, "ab"), (11, "a b"), (11, "a b")]


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_exact_dedup(spark, piece, monkeypatch):
    if piece != 1 << 20:
        monkeypatch.setattr(exact_dedup.fingerprint, "__defaults__", (piece,))
    got = table(exact_dedup.dedup(docs(spark, ROWS)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(plain_dedup(ROWS), key=repr)


def test_exact_dedup_of_null_and_repeated_ids_is_linear(spark):
    df = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 50).cast("string")).alias("text"), *(F.lit(0).alias(c) for c in ("n_norm", "fp1", "text_sha256", "row")))
    got = exact_dedup.dedup(df)
    assert {r["group_size"] for r in got.select("group_size").distinct().collect()} == {200} and got.count() == 10_000
    fps = exact_dedup.fingerprint(df)
    assert exact_dedup.differing(df, fps).collect() == []


def test_exact_dedup_combines_pieces_as_one_text(spark):
    rows = [(1, "é x" * 3000), (2, "é x" * 3000), (3, "éx " * 3000), (4, "y" * 8999)]
    whole, cut = (table(exact_dedup.fingerprint(docs(spark, rows), piece), "doc_id", "n_cp", "n_norm", "fp1", "fp2", "text_sha256") for piece in (1 << 20, 700))
    assert whole == cut
    assert exact_dedup.dedup(docs(spark, [])).collect() == []


def test_exact_dedup_splits_equal_fingerprints(spark, monkeypatch):
    same = spark.createDataFrame([(i, len(t), 5, 1, 1, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, "abcde"), (2, "abcde"), (3, "edcba"))], "doc_id long, n_cp long, n_norm long, fp1 long, fp2 long, text_sha256 string")
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda d: same)
    got = table(exact_dedup.dedup(docs(spark, [(1, "abcde"), (2, "abcde"), (3, "edcba")])), "doc_id", "keep_id", "group_size")
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


# --- 2 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(random_words(rng, rng.randrange(30))) or None, rng.choice(["b", "a", "zz", None, "hot", "hot", "hot", "é"])) for i in range(300)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixed_is_the_mix(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(random_words(rng, rng.randrange(30))) or None, rng.choice(["b", "a", None, "hot", "hot", "hot"])) for i in range(200)]
    rows += [(None, "n one two", "a")] * 20 + [(7, "again and again", "b")] * 20 + [(None, f"null {i}", "hot") for i in range(30)]
    d = docs(spark, rows)
    plan = mixing.mix(d)
    taken = {r["source"]: r["t"] for r in plan.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    out = mixing.mixed(d).collect()
    got = {}
    for r in out:
        n = len(WORD.findall(r["text"]))
        assert n == r["mix_words"] > 0 and r["size"] == 1
        got[r["source"]] = got.get(r["source"], 0) + n
    assert got == {s: t for s, t in taken.items() if t}
    assert len(out) <= 3 * len(rows) and len(mixing.mixed(d.limit(0)).collect()) == 0 == len(mixing.mix(d.limit(0)).collect())
    whole = {(r[0], r[1]) for r in rows}
    cut = [r for r in out if (r["doc_id"], r["text"]) not in whole]
    assert len(cut) <= len(taken) and all(any(i == r["doc_id"] and t.startswith(r["text"]) for i, t in whole if t) for r in cut)
    one = docs(spark, [(1, "a b c", "s")] * 20 + [(2, "d", "s")])
    assert mixing.mix(one).count() == 21


# --- 3 chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|im_end|> &lt;|"), (1, 1, "user", None), (1, 2, "assistant", "x & <|im_start|>"), (1, 3, "user", "q"), (1, 4, "assistant", "y"), (1, 5, "user", "tail"), (2, 0, "us\ner", "&nl;\n"), (None, 0, "assistant", "n"), (3, 0, "assistant", "<"), (3, 0, "assistant", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    ex = chat.expand(df)
    assert {(r["conv_id"], r["example"]) for r in ex.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (3, 0), (3, 1)}
    got = {r["conv_id"]: r for r in chat.digest(ex).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    one = ex.where("conv_id = 1 and example = 1").first()
    assert one["formatted"][one["loss_start"] : one["loss_end"]] == "y" and "tail" not in one["formatted"]


# --- 4 tokens


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from fluxgrain.llm import tokens

    path = P.path("word_bpe_49k.json")
    f = tokens.Stretches(tokens.Transducer(path))
    want = lambda s: len(f.transducer.library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(3)
    letters = [*"abcdefthein sABZ  \t\n\x0b\r'012,.!<|>éÉüßñÇΣςİ漢😀ﬁ½ª́ \x1c\x85", "<|endoftext|>", "don't ", "'ll", "<|startoftext|>"]
    for _ in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert tokens.count_text(s.encode(), f, rng.choice([1, 3, 7, 1000])) == want(s), s
    for s in ("thing" * 900, "é" * 999, "!?" * 400):
        assert tokens.count_text(s.encode(), f, 64) == want(s)
    t = f.transducer
    symbols = "".join(tokens.symbols_of(x) for w in "thing one two three".split() for x in t.pretokens(w.encode()))
    for cut in (1, 2, 3, 5, 100):
        maps = [tokens.chunk_map(symbols[i : i + cut], t) for i in range(0, len(symbols), cut)]
        prefixes = [t.run(0, symbols[: i + cut]) for i in range(0, len(symbols), cut)]
        assert [m(0) for m in tokens.scan(maps)] == prefixes and prefixes[-1] == (0, want("thing one two three"))
    # states are few, whichever words lead to them, and the table of transitions stays deterministic when entered again
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for w in words:
        assert t.run(0, tokens.symbols_of(w)) == (0, want(w))
    assert len(t.chains) < sum(map(len, words))
    before = dict(t.next)
    t.forget()
    assert all(t.run(0, tokens.symbols_of(w)) == (0, want(w)) for w in words[:200]) and before
    long = " ".join(words) * 3 + "x" * 70_000 + " <|endoftext|> é" + "naïve" * 20_000
    assert tokens.count_text(long.encode(), f) == want(long) and tokens.count_text(long.encode(), f, 1000) == want(long)
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x " * 3000)]
    got = table(tokens.token_counts(docs(spark, rows), path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted([(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (None, 6000, 3000, True)], key=repr)


# --- 5 html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>One<br><p>Two\n  words&nbsp;here</p><aside>side</aside><p>A<p>B &amp;lt;</p><form><p>subscribe</p></form><div class="comments"><p>first!</p></div></article>
<div id="sidebar"><p>links</p></div><footer>&copy; x</footer>"""


def test_html(spark):
    want = "Head & tail\nOne\nTwo words here\nA\nB &lt;"
    assert html.extract(PAGE) == want
    assert html.extract("") == "" and html.extract("<p>") == "" and html.extract("<!-- a") == ""
    body = "<div>" + "".join(f"<p>{'long text ' * 12}{i}</p>" for i in range(4)) + "</div>"
    free = html.extract(f"<body><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>{body}<p><a href=z>more and more</a></p></body>")
    assert free.split("\n") == [("long text " * 12) + str(i) for i in range(4)]
    assert html.extract("plain <script>x<y</script> text") == "plain text"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert table(html.extract_pages(df), "page_id", "text", "n_chars") == sorted([(1, want, len(want)), (2, "", 0), (None, "a", 1)], key=repr)


# --- 6 toxicity


def labelled(rng, n):
    rows, marks = [], []
    for i in range(n):
        w = random_words(rng, 40)
        bad = rng.random() < 0.2
        if bad:
            w[rng.randrange(40)] = "vile" + rng.choice(["ly", "ness", "st", ""])
        rows.append((i, " ".join(w)))
        marks.append((i, 0 if bad and i % 2 else 1, int(bad)))
    return rows, marks


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, marks = labelled(rng, 900)
    labels = spark.createDataFrame([m for m in marks if m[0] < 500] + [(5000, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*rows, (900, None), (901, "")])
    model = toxicity.train(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [m for m in marks if m[0] >= 500]
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in held) >= 0.99 * len(held)
    assert not got[900]["toxic"] and got[900]["severity"] == got[901]["severity"]
    assert np.all(np.diff(model.thetas) > 0)
    kept = toxicity.clean(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_toxicity_sample_is_bounded_and_takes_repeated_rows_once(spark):
    rng = random.Random(13)
    rows, marks = labelled(rng, 60)
    labels = spark.createDataFrame(marks * 3, "doc_id long, quality int, toxic int")
    grades, table_ = toxicity.sample(docs(spark, rows * 4), labels, 40)
    assert len(grades) == 40 and {r["text"] for r in table_.select("text").distinct().collect()} <= set(range(40))
    once, _ = toxicity.sample(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), 1000)
    again, _ = toxicity.sample(docs(spark, rows * 4), labels, 1000)
    assert once.tolist() == again.tolist() and len(once) == len(marks)
    same = [(1, "same text here")] * 500 + [(2, "bad")]
    grades, _ = toxicity.sample(docs(spark, same), spark.createDataFrame([(1, 1, 0)] * 300 + [(2, 1, 1)], "doc_id long, quality int, toxic int"), 10)
    assert len(grades) == 2


def test_toxicity_fit_is_stationary():
    """No weight's gradient exceeds the penalty, and that of a weight in use equals it."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 400)
    x = rng.random((400, 30)) < np.where(np.arange(30) < 6, 0.1 + 0.3 * grades[:, None], 0.2)
    row, col = np.nonzero(x)
    w, theta = toxicity.fit_weights(row, col, np.zeros(30), toxicity.base(grades), grades, 0.01, 3000)
    by_score, by_theta = toxicity.residuals(x @ w, theta, grades)
    pull = x.T @ by_score / 400
    assert np.all(np.abs(pull) <= 0.0103) and np.allclose(pull[w != 0], 0.01 * np.sign(w[w != 0]), atol=4e-4)
    assert np.all(np.abs(by_theta) / 400 < 1e-3) and np.all(w[:6] > 0)


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["toxic"] for r in toxicity.score(d, model).collect()] == [False, False]


# --- 7 url filter


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("example.net", "/en/x", "block")]
    urls = [None, "", "no scheme", "http://net/", "https://A.Example.NET/en/1?q=/de/", "http://example.net/en/xy", "http://notexample.net/en/", "http://a.net", "http://example.com/de/", "ftp://x.org/fr/#a", "http://b.example.com/en/://x.net/", "http:///en/", "http://.net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, "http://net/", "x")], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = table(urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id", "host", "path", "rule", "verdict")
    want = [(i, *plain_judge(u, rules)) for i, u in enumerate(urls)] + [(3, *plain_judge("http://net/", rules))]
    assert got == sorted(want, key=repr)
    none = urlfilter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_url_filter_of_many_lengths_long_urls_and_nothing(spark):
    rng = random.Random(7)
    words = lambda n: "".join(rng.choice("abé/") for _ in range(n))
    rules = [(rng.choice(["net", "x.net", "a.b.x.net", "org"]), "/" + words(n), rng.choice(["block", "allow"])) for n in range(120) for _ in range(2)]
    rules = list({(h, p): (h, p, v) for h, p, v in sorted(rules, key=lambda r: r[2])}.values()) + [(None, "/", "block"), ("net", None, "block")]
    known = [r for r in rules if r[0] and r[1]]
    urls = [f"http://{rng.choice(['', 'y.', 'a.b.'])}{h}{p}{words(rng.randrange(4))}" for h, p, _ in known]
    urls += ["http://" + "l." * 50_000 + "x.net/" + "a" * 50_000, "http://" + "l." * 8000 + "org" + known[-1][1]]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for c in ("host", "path", "verdict", "u", "best"):
        pages = pages.withColumn(c, F.lit("z"))
    list_ = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = table(urlfilter.judge(pages, list_), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *plain_judge(u, known)) for i, u in enumerate(urls)), key=repr)
    assert urlfilter.judge(pages.limit(0), list_).count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(5)
    b, h = urlfilter.BlockedBloom(2000), rng.integers(-(2**63), 2**63, 2000)
    b.add(h)
    assert b.might_contain(h).all()
    assert b.might_contain(rng.integers(-(2**63), 2**63, 20000)).mean() < 0.02


# --- 8 line dedup


def plain_lines(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = {i: [(n, s, len(WORD.findall(s))) for n, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\n\x0b\x0c\r").translate(lower))] for i, t in rows}

    def windows(x):
        for s in range(len(x)):
            total = 0
            for e in range(s, len(x)):
                total += x[e][2]
                if total >= least:
                    yield s, e, tuple(v for _, v, _ in x[s : e + 1])
                    break

    first = {}
    for i in sorted(lines):
        for s, _, k in windows(lines[i]):
            first.setdefault(k, (i, s))
    out = {}
    for i, t in rows:
        gone, x = set(), lines[i]
        for s, e, k in windows(x):
            i0, s0 = first[k]
            if (i0, s0) != (i, s):
                y, e0 = lines[i0], s0 + e - s
                while e + 1 < len(x) and e0 + 1 < len(y) and x[e + 1][1] == y[e0 + 1][1]:
                    e, e0 = e + 1, e0 + 1
                while s > 0 and s0 > 0 and x[s - 1][1] == y[s0 - 1][1]:
                    s, s0 = s - 1, s0 - 1
                gone |= set(range(x[s][0], x[e][0] + 1))
        out[i] = None if t is None else "\n".join(v for n, v in enumerate(t.split("\n")) if n not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [" ".join(random_words(rng, rng.choice([0, 1, 3, 8, 25]), 50)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(14)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "a\n" * 50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), 12).collect()}
    assert got == plain_lines(rows, 12)


def test_line_dedup_takes_blank_lines_with_runs_and_long_documents(spark):
    rng = random.Random(16)
    pool = [" ".join(random_words(rng, n, 50)) for n in (25, 14, 13, 5, 2, 0, 30, 12)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(1, 5)) for x in [*rng.choice(runs), *([""] if rng.random() < 0.5 else [f"only {i}"])])) for i in range(80)]
    rows.append((80, "\n".join(x for _ in range(400) for x in rng.choice(runs))))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), 12).collect()}
    assert got == plain_lines(rows, 12)


def test_line_dedup_selects_fewer_fingerprints_than_windows():
    rng = np.random.default_rng(3)
    hashes, words = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(1, 9, 3000)
    start, end, at, _ = line_dedup.windows(hashes, words, 20)
    assert all(hashes[a] == hashes[s : e + 1].min() for s, e, a in zip(start, end, at, strict=True))
    assert len(np.unique(at)) < 0.6 * len(start)


def test_line_dedup_of_null_ids_and_nothing(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    got = line_dedup.dedup_lines(docs(spark, [(None, long_line), (None, long_line), (1, long_line), (2, "x\n" + long_line)])).collect()
    assert sorted((repr(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("2", 1), ("None", 0), ("None", 0)]
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_line_dedup_of_repeated_ids_with_other_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    only = ["p q", "r s"]
    rows = [(0, a), (1, "\n".join(["x", "y", "z", a])), (1, "\n".join(only)), (1, "\n".join([*only, "t", b])), (2, "u\n" + b)]
    got = table(line_dedup.dedup_lines(docs(spark, rows)), "doc_id", "text")
    assert got == sorted([(0, a), (1, "x\ny\nz"), (1, "p q\nr s"), (1, "\n".join([*only, "t", b])), (2, "u")], key=repr)


# --- 9 n-gram join


def plain_join(rows, k, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                parent[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100), (3, 40, 100)])
def test_ngram_join(spark, k, num, den):
    rng = random.Random(k)
    rows = []
    common_passage = random_words(rng, 30)
    for _ in range(25):
        base = random_words(rng, rng.choice([1, 2, 5, 6, 20, 60, 150]))
        if rng.random() < 0.4:
            base += common_passage
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(["zzz", *base])
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(3)] or w
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "One", "one", "a b", "A\tb"])]
    got = table(ngram_join.join(docs(spark, rows), k, num, den), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_join(rows, k, num, den), key=repr)


def test_ngram_join_opens_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rng = random.Random(9)
    base = random_words(rng, 60, 100000)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = table(ngram_join.join(docs(spark, rows), 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_join(rows, 4, 85, 100), key=repr)


def test_ngram_join_opens_groups_whose_only_member_is_another_set(spark):
    rng = random.Random(12)
    hub = random_words(rng, 104, 100000)
    rows = [(0, " ".join(hub))] + [(i, " ".join(hub + [f"v{i}x{j}" for j in range(14 + i % 8)])) for i in range(1, 25)]
    for i in range(25, 65, 2):
        short = random_words(rng, rng.randrange(8, 14), 100000)
        rows += [(i, " ".join(short)), (i + 1, " ".join([*short, f"v{i}"]))]
    got = table(ngram_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_join(rows, 5, 80, 100), key=repr)


def test_ngram_join_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = ngram_join.join(docs(spark, [(5, text), (5, text), (None, text), (None, "alone here")]), 4, 85, 100)
    assert table(got, "doc_id", "component_id") == sorted([(5, 5), (5, 5), (None, 5), (None, None)], key=repr)
    assert ngram_join.join(docs(spark, []), 4, 85, 100).collect() == []


def test_ngram_join_keeps_texts_of_null_and_repeated_ids_apart(spark):
    rng = random.Random(14)
    a, b, c = (random_words(rng, 60) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "zz"])
    rows = [(None, " ".join(a)), (None, " ".join(b)), (None, " ".join(b)), (1, near(a)), (2, near(b)), (3, " ".join(c)), (3, "other text " * 9), (4, near(c))]
    got = ngram_join.join(docs(spark, rows), 5, 80, 100)
    want = [(None, 1, False), (None, 2, False), (None, 2, False), (1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert table(got, "doc_id", "component_id", "first") == sorted(want, key=repr)
    many = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), (F.col("id") % 40).cast("string")) for i in range(12))).alias("text"))
    got = ngram_join.join(many, 5, 80, 100)
    assert got.count() == 10_000 and got.where("component_id is null").count() == 10_000


def test_forest_connects_what_the_links_do():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.02, 0.1, 0.9, 1.0):
        linked = rng.random((37, 29)) < share
        q, m = np.arange(37), np.arange(100, 129)
        a, b = ngram_join.forest(linked, q, m)
        assert all(linked[x, y - 100] for x, y in zip(a, b, strict=True))

        def parts(edges):
            p = {i: i for i in [*q.tolist(), *m.tolist()]}

            def find(i):
                while p[i] != i:
                    i = p[i]
                return i

            for x, y in edges:
                p[find(x)] = find(y)
            groups = {}
            for i in p:
                groups.setdefault(find(i), set()).add(i)
            return {frozenset(g) for g in groups.values()}

        want = parts([(int(x), int(y) + 100) for x, y in np.argwhere(linked)])
        assert parts(zip(a, b, strict=True)) == want and len(a) == 66 - len(want)


# --- 10 decontamination


def plain_hits(rows, items):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    found = set()
    for i, t in rows:
        w = cut(t)
        for j, x in items:
            v = cut(x)
            if not v:
                continue
            wide = min(len(v), 20)
            for start in range(-len(v), len(w)):
                agree = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
                if any(100 * sum(agree[s : s + wide]) >= 80 * wide for s in range(len(v) - wide + 1)):
                    found.add((i, j))
    return found


def test_decontamination(spark, monkeypatch):
    rng = random.Random(10)
    items = [(j, " ".join(random_words(rng, n, 3000)) + ".") for j, n in enumerate([15, 18, 20, 33, 57, 3])] + [(9, None)]
    rows = []
    for i in range(60):
        w = random_words(rng, rng.randrange(5, 80), 3000)
        if i % 2:
            v = items[rng.randrange(5)][1].split()
            for p in rng.sample(range(len(v)), rng.randrange(0, 1 + len(v) // 4)):
                v[p] = "sub"
            at = rng.randrange(len(w))
            w[at:at] = v[rng.randrange(3) :] if len(v) > 25 else v
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (63, "x " + items[4][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    d = docs(spark, rows)
    got = decontam.hits(d, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == plain_hits(rows, items)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # the way of a benchmark too large to broadcast
    assert table(decontam.hits(d, bench), "doc_id", "item_id", "start", "matched") == table(got, "doc_id", "item_id", "start", "matched")
    kept = decontam.decontaminate(d, bench)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {a for a, _ in plain_hits(rows, items)})
    assert decontam.hits(docs(spark, []), bench).collect() == [] and decontam.hits(d, bench.limit(0)).collect() == []


def test_decontamination_recall_of_every_length(spark):
    """Items of 1 to 24 words with 20% of their words substituted at random, in the middle and at the ends of documents."""
    rng = random.Random(11)
    items, rows, want = [], [], set()
    for n in range(1, 25):
        for r in range(12):
            j = n * 100 + r
            v = [f"i{j}x{k}" for k in range(n)]
            items.append((j, " ".join(v)))
            for p in rng.sample(range(n), n - -(-n * 80 // 100)):
                v[p] = f"sub{j}"
            a, b = random_words(rng, rng.choice([0, 9])), random_words(rng, rng.choice([0, 9]))
            rows.append((j, " ".join(a + v + b)))
            want.add((j, j))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(docs(spark, rows), bench).collect()}
    assert got == want == plain_hits(rows, items) & want


def test_decontamination_keeps_clean_rows_of_null_and_repeated_ids(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, "clean one"), (None, item), (None, "clean two"), (7, "clean"), (8, "x " + item), (8, "clean eight")]
    bench = spark.createDataFrame([(1, item), (1, item), (None, "clean eight")], "item_id long, text string")
    kept = decontam.decontaminate(docs(spark, rows), bench)
    assert table(kept, "doc_id", "text") == sorted([(None, "clean one"), (None, "clean two"), (7, "clean")], key=repr)
    many = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, item).otherwise(F.concat(F.lit("c "), "id")).alias("text"), F.lit(1).alias("tie"), F.lit(1).alias("words"))
    assert decontam.decontaminate(many, bench).count() == 5000 and decontam.hits(many, bench).count() == 1


def test_decontamination_is_native(spark):
    plan = decontam.hits(docs(spark, [(1, "a")]), spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_masks_meet_every_window():
    from itertools import combinations

    for n, gone in ((20, 4), (19, 3), (15, 3)):
        for out in combinations(range(n), gone):
            assert any(all(i + o not in out for o in m) for m in decontam.MASKS for i in range(n - decontam.SPAN + 1))
