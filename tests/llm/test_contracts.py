"""What the contracts fix, against plain Python, and every operator on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from importlib import import_module

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import fingerprints, jaccard_join, line_dedup, mixing, packing, queries, secret_scan, token_files, topk, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use for themselves.
CLASH = "gone_id long, label_id long, `to` int, part int, mix_of string, mix_copy int, keep_bits string, score double, `size` int, `Hash` string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
MORE = (5, 6, 7, 8, "m", 9, "k", 0.5, 3, "h")


def table(spark, rows):
    """Rows of (doc_id, text, source) with all columns of DOCS."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *MORE) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(1, 60))), f"s{i % 4}") for i in range(30)]
    rows += [(None, None, None), (None, "no id", None), (None, "no id", None), (31, None, "s1"), (32, "", "s2"), (33, "word " * 60_000, "s0")]
    return [*rows, rows[3], rows[3], (4, "another text for a known id", "s3"), (None, "other", "s2")]


def test_apply_mix_takes_what_mix_sources_says(spark, odd):
    docs = table(spark, odd)
    told = Counter()
    for r in mixing.mix_sources(docs).collect():
        told[r["doc_id"], r["size"], r["source_size"]] += r["taken"]
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    sizes = defaultdict(int)
    for _, t, s in odd:
        sizes[s] += len(WORD.findall(t or ""))
    found = Counter()
    rows = out.collect()
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        found[r["doc_id"], n, sizes[r["source"]]] += n
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in told.items() if v}
    assert sum(not WORD.search(r["text"] or "") for r in rows) == sum(not WORD.search(t or "") for _, t, _ in odd)


def test_mix_joins_sources_by_shuffle_too(spark, odd, monkeypatch):
    docs = table(spark, odd)
    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == want


def test_mix_shuffles_no_text(spark, odd):
    plan = mixing.apply_mix(table(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_line_texts(spark, odd):
    lines = ["a line that many documents share, word for word", "  A LINE that many documents share, word for word\t", "short"]
    rows = [*odd, *((100 + i, f"text {i}\n{lines[i % 2]}\n{lines[2]}\n{lines[0] if i % 3 else ''}", "s") for i in range(8))]
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[line.strip(" \t\n\x0b\x0c\r").translate(UPPER)].add(-1 if i is None else i)
    gone = lambda i, k: len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != (-1 if i is None else i)
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x.strip(" \t\n\x0b\x0c\r").translate(UPPER)))) for i, t, _ in rows]
    out = line_dedup.dedup_lines(table(spark, rows))
    got = out.collect()
    assert out.columns == table(spark, rows).columns and sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["gone_id"] == 5 for r in got)
    assert any(a != b for (_, a), (_, b, _) in zip(want, rows, strict=True))


def test_lines_are_hashed_once(spark, odd):
    """The ranges' bounds are found on written hashes: no plan has the hashing below a range partitioning."""
    seen = []
    real = line_dedup.written
    line_dedup.written = lambda df, name, **more: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name, **more))[1]
    try:
        line_dedup.line_bitmaps(table(spark, odd))
    finally:
        line_dedup.written = real
    by = dict(seen)
    assert "MapInArrow" in by["hashes"] and "rangepartitioning" in by["lines"] and "MapInArrow" not in by["lines"]


def pairs_of_words(text):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_of_the_shipped_scale(spark):
    """Estimates from one in four hashes are near the truth, the more so the more shingles there are."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        text = r.choices(words, k=r.choice([300, 900, 3000]))
        rows.append((i, " ".join(text)))
    rows += [(60 + i, rows[i][1][: len(rows[i][1]) * 2 // 3]) for i in range(0, 60, 4)]
    rows.sort(key=lambda x: -x[0])
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = []
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        new = fingerprints.edited(text, following)
        a, b, c = map(pairs_of_words, (text, new, following))
        kept = fingerprints.from_string(got[i]["fingerprint"])
        assert len(kept) < len(a) / 2 and (np.diff(kept.astype(object)) > 0).all()
        for name, truth, n in (("near_edited", len(a & b) / len(a | b), len(a | b)), ("near_next", len(a & c) / len(a | c), len(a | c)), ("in_edited", len(a & b) / len(a), len(a)), ("in_next", len(a & c) / len(a), len(a))):
            errors.append((got[i][name] - truth) * (n / fingerprints.SCALE) ** 0.5)
    assert abs(np.mean(errors)) < 0.2 and np.sqrt(np.mean(np.square(errors))) < 0.6 and np.abs(errors).max() < 2.5


BASE = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def test_base_spans_of_secrets(spark):
    r = random.Random(9)
    bits = ["password", "Api_Key", "TOKEN", "secret", "=", ":", " ", '"', "'", "\n", "abcdef012345", "0123456789abcdef", "AKIA", "ABCDEFGH01234567", "é", "x.y-z_/+", "passwd", "deadbeefcafe", "ſ", "K"]
    texts = [None, "", *("".join(r.choices(bits, k=r.randrange(1, 25))) for _ in range(400)), "password=" + "a1" * 60_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for row in secret_scan.scan_documents(docs).collect():
        text = texts[row["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        spans.sort()
        assert [row[c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
        told = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(row["spans"].split(","))or not told


@pytest.mark.parametrize(
    "text, marks",
    [
        ("you idiot", "Tt"), ("What an idiot you are", "OOtTO"), ("idiot", "I"), ("he is no idiot", "TONi"), ("not an idiot", "NOi"),
        ("an idiot, not you", "OtNT"), ("she said idiot", "TRr"), ("idiot, she said", "tTR"), ("I will kill you", "OOxT"), ("you I kill", "TOx"),
        ("never kill", "Nh"), ("kill never", "HN"), ("kill", "H"), ("they wrote kill", "TRr"), ("kill a b c d you", "HOOOOT"),
    ],
)
def test_scopes_in_both_orders(text, marks):
    matcher = toxicity.Matcher(toxicity.Model({"idiot$": 3.0}))
    symbols = []
    for w in re.findall(r"\w+", text.lower()):
        symbols.append("I" if w == "idiot" else "H" if w in matcher.threats else matcher.kinds.get(w, "O"))
    assert "".join(matcher.machine.run(symbols)) == marks


def test_scores_of_clauses_by_hand():
    """Features of small texts against sums done by hand."""
    matcher = toxicity.Matcher(toxicity.Model({"idiot$": 3.0, "grob": 2.0}))
    c = toxicity.CONTEXTS
    for text, clauses in [("You idiot. Fine.", [3 * c["t"]]), ("I will kill you. He is no idiot!", [2 * c["x"], 3 * c["i"]]), ("grobian; she said idiot", [2 * c["I"], 3 * c["r"]]), ("Murder", []), ("", [])]:
        f = matcher.features(text)
        assert f[:3] == pytest.approx([max(clauses), np.log1p(sum(clauses)), np.log1p(len(clauses))] if clauses else [0.0] * 3), text
    m = toxicity.Model({"idiot$": 3.0})
    assert m.matcher().score("I will kill you.") > m.matcher().score("") == m.matcher().score("The harvest was good.")


def test_drop_toxic_by_score(spark, odd):
    model = toxicity.Model({"idiot$": 5.0}, [-3.0, 2.0, 0.5, 0.5, 0.0, 0.0])
    docs = table(spark, [*odd, (50, "You are an idiot, an idiot!", "s1"), (51, "Good morning to you.", "s1")])
    out = toxicity.drop_toxic(docs, model)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and len(ids) == len(odd) + 1 and 51 in ids and 50 not in ids
    assert toxicity.drop_toxic(docs.limit(0), model).count() == 0


def test_url_model_on_held_out_rows():
    """A fifth of the labelled table by hash, not trained on."""
    held = [zlib.crc32(u.encode()) % 5 == 0 for u, _ in url_filter.LABELLED]
    w, b = url_filter.train([x for x, h in zip(url_filter.LABELLED, held, strict=True) if not h])
    score = lambda u: 1 / (1 + np.exp(-(w[(g := url_filter.grams(*url_filter.split_url(u)))].sum() / len(g) ** 0.5 + b)))
    got = [(score(u) >= 0.5, bool(t)) for (u, t), h in zip(url_filter.LABELLED, held, strict=True) if h]
    assert np.mean([a == t for a, t in got]) > 0.88 and not any(a and not t for a, t in got)


def test_urls_by_rule(spark):
    r = random.Random(4)
    bits = ["http://", "HTTPS://", "://", "a.", "WWW.", "example.com", "example.net", "Example.Com", "net", "org", "com", "/en/", "/en/7", "/de/8", "/de/", "/es/x", "?q", "#t", "/", "é", "\n"]
    urls = [None, "", *("".join(r.choices(bits, k=r.randrange(1, 6))) for _ in range(500)), "http://x.com/" + "en/" * 50_000, "http://x.com/en/1", "http://x.com/en/1"]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, rule string, score double")
    for row in url_filter.filter_urls(pages).collect():
        host, path = url_filter.split_url(urls[row["page_id"]])
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[row["page_id"]] or "")
        assert (row["host"], row["path"]) == (host, path) == ((m[1].translate(UPPER), m[2]) if m else ("", ""))
        fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert row["rule"] == (max(fit)[1] if fit else None)
        assert row["verdict"] == (max(fit)[2] if fit else "block" if row["score"] >= 0.5 else "allow")
        if not host and not path:
            assert (row["score"], row["verdict"]) == (0.0, "allow")
    own = spark.createDataFrame([("http://aaa.test/", 1), ("http://bbb.test/", 0), (None, 1)] * 3, "url string, label int")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(1, "http://aaaa.test/"), (2, "http://bbbb.test/")], "page_id long, url string"), labelled=own).collect()}
    assert verdicts == {1: "block", 2: "allow"}


def test_all_operators_on_odd_rows(spark, odd):
    """Columns of clashing names, nulls, empty and long texts, repeated rows; then no rows at all."""
    docs = table(spark, odd)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(20)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, label_id int")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, -2.0 * i], 1, 2, 3, 4.0, "p") for i in range(250)], "vec_id long, embedding array<float>, `rank` int, `to` int, part int, norm double, query_id string")
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "h", "v", 1), (1, "http://a.com/en/1", "h", "v", 1), (None, None, None, None, 1)], "page_id long, url string, host string, verdict string, score int")
    n = len(odd)
    runs = [
        (lambda d: toxicity.toxicity(d, labels), docs, n), (mixing.mix_sources, docs, n), (url_filter.filter_urls, pages, 3),
        (lambda d: packing.pack_documents(d, queries.VOCABULARY), docs, None), (secret_scan.scan_documents, docs, n), (fingerprints.fingerprint_documents, docs, n),
        (lambda d: token_files.read_token_files(*token_files.write_token_files(d, queries.VOCABULARY)), docs, n), (line_dedup.line_report, docs, n),
        (topk.top_k, vectors, 30), (jaccard_join.near_duplicates, docs, n), (jaccard_join.keep_representatives, docs, None), (mixing.apply_mix, docs, None),
    ]
    for run, rows, count in runs:
        found = run(rows).count()
        assert found == count if count is not None else found > 0
        assert run(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["mix_targets", "url_rules", "secret_counts"])
def test_sql_of_parts(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), c.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage on what the one before left."""
    pipeline = import_module("corpus_pipeline")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "source_mix", "packing"]
    r = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("lor", "ips", "dol", "sit") for b in ("um", "em", "or") for c in ("a", "e", "ix", "on")]
    shared = "this long line stands in many documents of the table"
    rows = []
    for i in range(240):
        own = r.choices(words, k=60)
        if i % 6 == 0:
            for _ in range(6):
                own.insert(r.randrange(len(own)), r.choice(["grobnix", "grobnax"]))
        rows.append([i, " ".join(own) + ".", f"s{i % 3}"])
    for i in (1, 2, 3, 4, 5, 7, 8):
        rows[i][1] += f"\n{shared}"
    rows[20][1] = rows[19][1] + " extra"
    rows[21][1] = rows[19][1].upper()
    rows += [[300, None, None], [301, "", "s0"], [19, rows[19][1], "s1"], [None, "null id text here now", "s2"]]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    plain = lambda rs: sorted(((x["doc_id"], x["text"]) for x in rs), key=str)
    clean = [(i, t) for i, t, _ in rows if i is None or i >= 240 or i % 6]
    assert plain(kept[0]) == sorted(clean, key=str)
    holder = max(i for i, t in clean if t and shared in t)
    deduped = [(i, t if not t or i == holder else "\n".join(x for x in t.split("\n") if x != shared)) for i, t in clean]
    assert plain(kept[1]) == sorted(deduped, key=str)
    assert plain(kept[2]) == sorted(((i, t) for i, t in deduped if i not in (20, 21)), key=str)
    times = {(x["doc_id"], x["size"]): x["taken"] // x["size"] for x in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/jaccard_join")).collect() if x["size"]}
    want = Counter()
    for x in kept[2]:
        n = len(WORD.findall(x["text"] or ""))
        want[x["doc_id"], x["text"]] += times[x["doc_id"], n] if n else 1
    assert Counter((x["doc_id"], x["text"]) for x in kept[3]) == +want
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    assert Counter((x["doc_id"], x["ids_crc32"]) for x in kept[4]) == Counter((x["doc_id"], zlib.crc32(np.array([*library.encode(x["text"] or "").ids, 0], "<u4").tobytes())) for x in kept[3])
    empty = tmp_path / "none"
    table(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0 and F is not None
