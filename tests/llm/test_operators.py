import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from ferrule.llm import bpe, hmm, images, langid, lines, packing, passages, pii, pivots, simhash
from ferrule.llm.common import components
from ferrule.llm.tokens import ByteBpe, WordBpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a to in is was for that with on at by from this it as be are river stone green house window paper cloud simple letter bright".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [prose(rng, n) for n in (1, 3, 4, 5, 60, 200, 900, 5000)]
    out += [None, "", " \n\t ", out[5], out[5], out[5].replace("river", "lake", 1), "É" * 40, "word " * 500, "<|endoftext|> 1234 's Don't"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    # an extra column, a repeated row, names that the operators use themselves
    df = spark.createDataFrame([*rows, rows[6]], DOCS)
    return df.withColumns({"th": F.lit(1), "spans": F.lit("x"), "n_lines": F.lit(2), "score": F.lit(0)}).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 9), (9, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    ids, places = Counter(), defaultdict(list)
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert (len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(want[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        ids[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert ids == {i: len(w) * (2 if i == 6 else 1) for i, w in want.items()}
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1].tolist()] and sum(n for _, n in p) <= 2048
    assert packing.pack(empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    full, mine = Tokenizer.from_file(path), WordBpe(path, memo=30)
    rng = random.Random(21)
    chars = [chr(c) for c in range(0x21)] + list("\x7f\x85\xa0\u2003\u3000'sS'LLdtreé É̈ßİσΣςǅ0１½²_.,!-😀中<|>ªµ÷×") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the ", "House", "don't", "x" * 1200]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [None, ""]
    for at in range(0, len(texts), 40):
        ids, ends = mine.encode_column(pa.array(texts[at : at + 40], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [full.encode(t or "", add_special_tokens=False).ids for t in texts[at : at + 40]]


def test_histogram_packing_places_everything():
    rng = random.Random(2)
    for _ in range(50):
        h = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(0, 30))}
        got = Counter()
        for n, ls in packing.pack_histogram(h, 64):
            assert sum(ls) <= 64
            for length in ls:
                got[length] += n
        assert got == h


def test_byte_bpe(spark, docs, texts):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(docs, path, P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))
    coded = bpe.encode(docs.where("doc_id in (8, 14, 16)"), path, P.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode(coded, path, P.PATTERN).collect()} == {i: texts[i] or "" for i in (8, 14, 16)}
    b = ByteBpe(path, P.PATTERN)
    rng = random.Random(3)
    for _ in range(3000):
        x = "".join(rng.choice(" \t\n\x1c\x85\xa0　aAé1²'sd.!😀́中") for _ in range(rng.randint(0, 12)))
        ids = enc.encode_ordinary(x)
        assert b.encode_column(pa.array([x])) == ([",".join(map(str, ids))], [x.encode()])
        spans = b.offsets(x)
        assert [s[0] for s in spans] == ids and all(0 <= s < e <= len(x) for _, s, e in spans)
    assert bpe.digests(empty(spark), path, P.PATTERN).count() == 0


def test_language_id(spark, texts):
    rng = random.Random(4)
    kinds = {"aa": "bcdfa", "ee": "ghjke", "oo": "lmnpo"}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, make(k, 40), k, "s", 0) for i, k in enumerate(list(kinds) * 40)] + [(900, None, "aa", "s", 0), (901, "123 !?", None, "s", 0), (902, make("ee", 30), None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(5))
    model = langid.fit(df.where("doc_id % 3 <> 1 or doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows[:120]))
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "ee")
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[902].rejected and got[901].rejected
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def simhash_of(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: simhash_of(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    root = dict.fromkeys(fp)
    for i in fp:
        reach, todo = {i}, [i]
        while todo:
            j = todo.pop()
            new = {k for k in fp if k not in reach and (fp[j] ^ fp[k]).bit_count() <= 4}
            reach |= new
            todo += new
        root[i] = min(reach)
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.near_duplicates(docs).count() == len(texts) + 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 8)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(40)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    for i in range(len(fps)):
        reach, todo = {i}, [i]
        while todo:
            j = todo.pop()
            new = {k for k in range(len(fps)) if k not in reach and (fps[j] ^ fps[k]).bit_count() <= 4}
            reach |= new
            todo += new
        assert got.get(i, i) == min(reach)


def dedup(rows, m, chars):
    """Brute force: every run of m lines, or long line, that occurred before."""
    seen, out = set(), {}
    grams = []
    for doc, text in rows:
        own = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        grams += [((doc, j), tuple(x for _, x in own[j : j + m]), [i for i, _ in own[j : j + m]]) for j in range(len(own) - m + 1)]
        grams += [((doc, j), x, [i]) for j, (i, x) in enumerate(own) if len(x) >= chars]
    gone = defaultdict(set)
    for (doc, _), g, at in sorted(grams, key=lambda x: x[0]):
        if g in seen:
            gone[doc].update(at)
        seen.add(g)
    for doc, text in rows:
        out[doc] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc])
    return out


@pytest.mark.parametrize("m", [2, 3, 4])
def test_line_dedup(spark, m):
    rng = random.Random(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "long " * 14, " ", "c d"]) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit(1), "n_removed": F.lit(1)})
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_lines=m).collect()}
    assert got == dedup(rows, m, lines.MIN_CHARS)
    assert lines.dedup_lines(df.limit(0), min_lines=m).count() == 0
    twice = lines.dedup_lines(df.unionAll(df), min_lines=m)
    assert twice.count() == 2 * len(rows) and twice.columns == ["doc_id", "text", "th", "n_lines", "n_removed"]


def runs_of(rows, m):
    """Brute force: (doc, line) -> longest repeated run that starts there, and whether its first m lines stand further up."""
    own = {d: [x for x in (t or "").split("\n") if x.strip(" ")] for d, t in rows}
    copies, first = Counter(), {}
    for d, x in sorted(own.items()):
        for i in range(len(x)):
            for n in range(1, len(x) - i + 1):
                copies[tuple(x[i : i + n])] += 1
                first.setdefault(tuple(x[i : i + n]), (d, i))
    out = {}
    for d, x in own.items():
        for i in range(len(x)):
            longest = max((n for n in range(1, len(x) - i + 1) if copies[tuple(x[i : i + n])] > 1), default=0)
            if longest:
                out[d, i] = (longest, longest >= m and first[tuple(x[i : i + m])] != (d, i))
    return out


@pytest.mark.parametrize("m", [1, 2, 5])
def test_repeated_runs(spark, m):
    rng = random.Random(30 + m)
    passage = [f"p{i}" for i in range(41)]
    rows = []
    for i in range(30):
        cut = rng.randint(0, 40)
        x = [rng.choice("abc") for _ in range(rng.randint(1, 9))] + passage[cut : cut + rng.randint(0, 41)] + [f"own{i}"] * rng.randint(0, 2)
        rows.append((i, "\n".join(x + [rng.choice("ab") for _ in range(rng.randint(0, 20))])))
    rows += [(40, "a\n" * 70), (41, "c\n \n" + "a\n" * 70), (42, "\n".join(passage)), (43, ""), (44, "\n".join(["z", *passage]))]
    texts = lines.text_table(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.at): (r.length, r.later) for r in lines.repeated_runs(texts, m).collect() if r.length}
    assert got == runs_of(rows, m)


def test_line_dedup_of_copies(spark):
    long = "long " * 14
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb"), (4, "q"), (5, "q"), (6, long), (7, long + "\n"), (8, long), (8, "q"), (9, "q\n\nq"), (10, "q\n\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()]
    want = [(None, "a\nb\nc", 3, 0), (1, "", 3, 3), (2, "", 3, 3), (3, "", 2, 2), (4, "q", 1, 0), (5, "q", 1, 0), (6, long, 1, 0), (7, "", 1, 1), (8, "", 1, 1), (8, "q", 1, 0), (9, "q\n\nq", 2, 0), (10, "", 2, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)


SPEC = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, p) in enumerate(SPEC.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_spans(spark):
    rng = random.Random(8)
    rows = ["".join(rng.choice("ab19 .@-+()_%é") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    rows += ["x a.b@c.de, 1.2.3.4, 4111 1111 1111 1111, +1 (555) 123-4567", None, "", "1" * 20_000, "1." * 9_000, "4 " * 9_000, "a@" + "b." * 9_000]
    rows += ["see a@b.co now " * 3_000, "é 1.2.3.4 " * 2_000]
    both = [*enumerate(rows), (800, rows[800]), (801, "also 5.6.7.8"), (None, "z@y.org"), (None, "+1 222 333 4444 55")]
    df = spark.createDataFrame(both, "doc_id long, text string").withColumns({"terms": F.lit(1), "th": F.lit(2)})
    found = pii.personal_data(df).select("doc_id", "text", "spans").collect()
    assert len(found) == len(both) and Counter(r.doc_id for r in found) == Counter(i for i, _ in both)
    for r in found:
        assert [(s.start, s.kind, s.end) for s in r.spans] == base_spans(r.text), r.text[:60]
        assert all(r.text[s.start : s.end] == s.value for s in r.spans)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect() if r.doc_id not in (801, None)}
    assert clean[800] == "x [EMAIL], [IP], [CARD], [PHONE]" and clean[802] == ""
    assert clean[807] == "see [EMAIL] now " * 3_000 and clean[808] == "é [IP] " * 2_000
    assert sorted(str(r.text) for r in pii.sanitise(df).where("doc_id is null or doc_id = 801").collect()) == ["None", "[EMAIL]", "[PHONE]", "also [IP]"]
    assert pii.sanitise(df).columns == df.columns
    assert pii.personal_data(df.limit(0)).count() == 0


def disclosing(rows, support, kind_support, least):
    """Brute force: term -> its largest share of documents with one entity."""
    docs = rows
    of, words = {}, {}
    for i, t in docs:
        found = base_spans(t)
        of[i, t] = {("v", k, re.sub("[ ().-]+", ".", t[a:b]).lower()) for a, k, b in found} | {("k", k, "") for _, k, _ in found} | ({("a", 0, "")} if found else set())
        words[i, t] = {w for w in re.findall(r"[^\W_]+", re.sub(SPEC["email"], " ", t).lower()) if len(w) >= 4 and re.search(r"[^\W\d_]", w)}
    n_t = Counter(w for d in docs for w in words[d])
    n_te, texts = Counter(), defaultdict(set)
    for d in docs:
        for w in words[d]:
            for e in of[d]:
                n_te[w, e] += 1
                texts[w, e].add(d[1])
    out = {}
    for (w, e), n in n_te.items():
        if len(texts[w, e]) >= (support if e[0] == "v" else kind_support) and n / n_t[w] >= least:
            out[w] = max(out.get(w, 0), n / n_t[w])
    return out


def test_disclosing_terms(spark):
    rng = random.Random(22)
    values = ["ann@x.org", "bob.b@mail.net", "10.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111"]
    vocabulary = ["zanzibar", "report", "file", "wordword", "tokens", "été4", "1234", "abcd12", "the", "quartz", "phoneline"] + [f"rare{i}" for i in range(30)]
    rows = []
    for i in range(400):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        if "rare7" in text:
            text.append("ann@x.org")
        if rng.random() < 0.3 or "quartz" in text:
            text += [rng.choice(values[:2] if "zanzibar" in text else values), rng.choice(["phoneline", "Zanzibar", "calls"])]
        rows.append((i % 350, " ".join(text)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = disclosing(rows, pii.SUPPORT, pii.KIND_SUPPORT, pii.GENERALISE)
    assert {"calls", "quartz", "rare7"} <= set(want)
    for r in pii.personal_data(df).collect():
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", r.text) if m[0].lower() in want]
        assert sorted((t.start, t.end) for t in r.terms) == spans
        assert all(t.share == pytest.approx(want[r.text[t.start : t.end].lower()]) for t in r.terms)
    near = [(i, f"report {w} by zanzibar kept ann@x.org for the {w} file, wordword") for i, w in enumerate(["red", "blue", "green", "black"])]
    rest = [(10 + i, f"the report was kept on file number {i}x, wordwordy") for i in range(30)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(near + rest, "doc_id long, text string")).collect()}
    assert clean[0] == "report red by  kept [EMAIL] for the red file, " and all(clean[i] == t for i, t in rest)


def test_hmm(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(hmm, "NEAR", 12)
    rows = {r.doc_id: r for r in hmm.score(docs, F.col("doc_id") % 2 == 0).collect()}
    used = [t for i, t in enumerate(texts) if i % 2 == 0] + [texts[6]]
    count = Counter(w for t in used for w in [*hmm.words(t), hmm.END])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w = [*hmm.words(t), hmm.END]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert hmm.score(empty(spark), F.lit(True)).count() == 0


def test_forward_and_counts_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0))
    seqs = [np.array(s) for s in ([0, 1, 2, 1], [2], [1, 1], [])]
    want_counts = np.zeros(2 + 4 + 6)
    for s in seqs:
        paths = {}
        for p in product(range(2), repeat=len(s)):
            q = 1.0
            for t, (z, x) in enumerate(zip(p, s, strict=True)):
                q *= (m.start[z] if t == 0 else m.moves[p[t - 1], z]) * m.emits[x, z]
            paths[p] = q
        total = sum(paths.values())
        assert m.log10([s])[0] == pytest.approx(np.log10(total))
        for p, q in paths.items() if len(s) else ():
            want_counts[p[0]] += q / total
            for t, (z, x) in enumerate(zip(p, s, strict=True)):
                want_counts[6 + 3 * z + x] += q / total
                if t:
                    want_counts[2 + 2 * p[t - 1] + z] += q / total
    for segment in (1, 2, 3, 128):
        got = m.expected(seqs, segment)
        assert got[:-2] == pytest.approx(want_counts)
        assert got[-2] == pytest.approx(sum(m.log10([s])[0] for s in seqs)) and got[-1] == 7


def test_hmm_score_against_the_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(hmm, "NEAR", 5)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefghijk"), rng.integers(0, 9), p=np.arange(11, 0, -1) / 66)) for _ in range(60)] + [None, "zz a qq"]
    held = []

    def fixed(encoded, unigram, **_):
        norm = lambda x, axis: x / x.sum(axis, keepdims=True)
        held.append(hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((len(unigram), 3)), 0)))
        return held[0]

    monkeypatch.setattr(hmm, "train", fixed)
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") < 40).collect()}
    count = Counter(w for t in texts[:40] for w in hmm.words(t))
    ranked = sorted(count, key=lambda w: (-count[w], w))
    levels = np.floor(np.log2([count[w] for w in ranked]) * 8)
    near = [w for w, s in zip(ranked, levels) if (levels >= s).sum() <= 5]  # whole steps of the count
    bucket = lambda w: zlib.crc32(w) % hmm.BUCKETS
    shared = defaultdict(list)
    for w in ranked[len(near) :]:
        shared[bucket(w)].append(count[w])
    m = held[0]
    for i, t in enumerate(texts):
        p, share = m.start, 1.0
        for n, w in enumerate([*hmm.words(t), None]):
            at = hmm.OWN + hmm.BUCKETS if w is None else near.index(w) if w in near else hmm.OWN + bucket(w)
            p = (p if n == 0 else p @ m.moves) * m.emits[at]
            if w is not None and w not in near:
                own = shared[bucket(w)]
                share *= (count[w] + 1) / (sum(own) + len(own) + 1)
        assert got[i] == pytest.approx(np.log10(p.sum() * share))


def test_hmm_training_finds_kinds_of_texts():
    rng = np.random.default_rng(5)
    kinds = [rng.dirichlet(np.full(60, 0.1)) for _ in range(3)]
    texts = [np.append(rng.choice(60, rng.integers(5, 400), p=kinds[i % 3]), 60) for i in range(240)]
    unigram = np.bincount(np.concatenate(texts[:200]), minlength=61).astype(float)
    model = hmm.Hmm.first(unigram, 4)
    for _ in range(5):
        model = model.updated(model.expected(texts[:200]), unigram)
    plain = np.log10((unigram + 0.5) / (unigram + 0.5).sum())
    gain = sum(model.log10([t])[0] - plain[t].sum() for t in texts[200:]) / sum(map(len, texts[200:]))
    assert gain >= 0.2


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SHARE", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 16)), np.repeat(x[:1], 40, 0) + 0.02 * rng.normal(size=(40, 16)), x[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    short = rng.normal(size=(30, 5))
    short = np.concatenate([short, short[:10] * 3 + 0.01])
    rows += [(500 + i, v.tolist(), 0) for i, v in enumerate(short)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, [], 0), (905, [1.0] * 4, 0)]
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = pivots.unit(x)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= true).all() and mine.sum() >= 0.9 * true.sum()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(900, 906))
    assert all(got[i].component_id == 0 for i in range(360, 400))
    w = pivots.unit(short)
    links = (w @ w.T >= 0.9).sum(axis=1) - 1
    mine = np.array([got[500 + i].n_links for i in range(40)])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum() and mine.sum() >= 20
    # a length that no pivot was chosen for: one list, everything compared
    monkeypatch.setattr(pivots, "SAMPLE", 1)
    few = pivots.near_vectors(spark.createDataFrame(rows[360:], "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in few if r.vec_id >= 500} == {500 + i: n for i, n in enumerate(links)}
    twice = pivots.near_vectors(spark.createDataFrame([rows[0], rows[0], (None, rows[0][1], 0), rows[1]], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links) for r in twice) == [(False, 0, 1), (False, 0, 1), (False, 1, 0), (True, 0, 0)]
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, fuzzy = text(55), text(120)
    edited = [w if i % 15 else word() for i, w in enumerate(fuzzy)]
    rows = [(i, " ".join(text(80))) for i in range(10)]
    rows += [(20, " ".join(text(30) + shared + text(40))), (21, " ".join(text(70) + shared)), (22, " ".join(shared + text(9)))]
    rows += [(30, " ".join(fuzzy + text(20))), (31, " ".join(text(50) + edited)), (40, None), (41, ""), (42, "one two three")]
    df = spark.createDataFrame([*rows, rows[11]], "doc_id long, text string")
    got = {(r.doc_id, r.source_doc_id): r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {(21, 20), (22, 20), (31, 30)}
    r = got[21, 20]
    assert (r.start_word, r.end_word, r.source_start, r.source_end, r.identity) == (70, 125, 30, 85, 1.0)
    assert got[31, 30].n_words >= 100 and got[31, 30].identity >= 0.9
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_texts_under_one_id(spark):
    rng = random.Random(23)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b = text(60), text(60)
    rows = [(1, a), (1, b), (1, a), (2, a + " " + text(5)), (3, text(5) + " " + b), (None, a), (None, b)]
    got = [{(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, rows[::-1])]
    assert got[0] == got[1] and got[0] in ({(2, 1)}, {(3, 1)})


def test_passages_around_a_foreign_middle(spark):
    rng = random.Random(13)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    head, mid, foot = text(60), text(50), text(70)
    rows = [(1, head + text(100) + foot), (2, head + text(110) + foot), (3, text(5) + head + text(60) + mid + text(80) + foot), (4, head + text(90) + mid + text(70) + foot)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.source_start, r.source_end) for r in passages.repeated_passages(df).collect()}
    both = lambda doc, at, end: {(doc, 1, at, at + 60, 0, 60), (doc, 1, end - 70, end, 160, 230)}
    assert got == both(2, 0, 240) | both(3, 5, 325) | both(4, 0, 340) | {(4, 3, 150, 200, 125, 175)}


def test_passages_whose_seeds_first_occur_apart(spark):
    rng = random.Random(14)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    a, b = text(50), text(120)
    rows = [(1, text(9) + a[:26] + text(30)), (2, text(40) + a[24:] + text(9))]  # parts of a, too short to be reported
    rows += [(10 + i, text(5) + b[20 * i : 20 * i + 30] + text(5)) for i in range(5)]
    rows += [(20, text(7) + a + text(60)), (21, text(30) + a), (22, a[:6] + text(3) + a + a[:6]), (30, text(11) + b), (31, b + text(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    got = {(r.doc_id, r.source_doc_id): r for r in found}
    assert set(got) == {(21, 20), (22, 20), (31, 30)}
    assert [got[k][1:7] for k in ((21, 20), (22, 20))] == [(30, 80, 20, 7, 57, 50), (9, 59, 20, 7, 57, 50)]
    parts = sorted((r.start_word, r.end_word) for r in found if (r.doc_id, r.source_start - r.start_word) == (31, 11))
    assert parts[0][0] == 0 and parts[-1][1] == 120 and all(a[1] - b[0] >= 39 for a, b in zip(parts, parts[1:]))


def test_passages_with_edits_against_brute_force(spark):
    """Passages at the threshold: each edit leaves four equal words at most, and the seeds that remain occur first elsewhere."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, pairs = [], {}
    for k in range(30):
        a, step = text(rng.choice((40, 45, 50, 60))), (5, 6, 8)[k % 3]
        b = [word() if i % step == step - 1 else w for i, w in enumerate(a)]
        if k % 2:  # a word more for every second edit, so that lengths differ
            b = [x for i, w in enumerate(b) for x in ([w, word()] if i % (4 * step) == step - 1 and step > 5 else [w])]
        rows += [(1000 + 2 * k, text(20) + a + text(15)), (1001 + 2 * k, text(9) + b + text(30)), (k, text(30) + a[:20] + text(30))]
        pairs[1001 + 2 * k, 1000 + 2 * k] = max(len(a), len(b)), passages.distance(*(np.array([hash(w) for w in x]) for x in (a, b)), 99)
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = {(r.doc_id, r.source_doc_id) for r in found}
    due = {p for p, (n, d) in pairs.items() if d <= n * (1 - passages.IDENTITY) + 1e-9}
    assert len(due) >= 25 and due - got == set() and got <= set(pairs)
    assert all(r.n_words >= passages.MIN_WORDS and r.identity >= passages.IDENTITY - 1e-9 for r in found)


def test_passages_of_a_variant_of_a_variant(spark):
    """The third text is within the threshold of the second alone, whose seeds all occur first in the first."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a = [word() for _ in range(60)]
    b = [word() if i % 8 == 3 else w for i, w in enumerate(a)]
    c = [word() if i % 8 == 7 else w for i, w in enumerate(b)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((a, b, c))], "doc_id long, text string")
    assert {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(df).collect()} == {(1, 0), (2, 1)}


def test_passages_of_common_lines_and_repeating_words(spark):
    """Runs of common lines alone make a passage where lines follow each other; a line that all hold makes no pair of each two."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    lines = [text(9) for _ in range(12)]
    rows = [text(40) + lines[0] + text(30) + lines[1 + i % 11] + text(40) for i in range(300)]
    due = set()
    for k in range(4):  # five lines in a row, three words of which are others in the copy
        a = [w for i in rng.sample(range(12), 5) for w in lines[i]]
        b = [word() if i % 15 == 3 * k + 1 else w for i, w in enumerate(a)]
        due.add((len(rows) + 1, len(rows)))
        rows += [text(25) + a + text(30), text(10) + b + text(20)]
    for k in range(4):  # a word repeated, and words around it that differ here and there
        a = text(14) + [f"w{k}"] * 25 + text(14)
        b = [word() if i in (5, 10, 44, 49) else w for i, w in enumerate(a) if i != 20]
        due.add((len(rows) + 1, len(rows)))
        rows += [text(25) + a + text(30), text(10) + b + text(20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    assert due <= {(r.doc_id, r.source_doc_id) for r in found} and all(r.doc_id >= 300 for r in found)
    words = passages.sketches(df).select(F.col("doc_id").alias("id"), "words").withColumn("covered", F.lit(None).cast("array<struct<start_word: int, end_word: int, identity: double>>"))
    assert passages._candidates(words).count() < 2_000  # 300 documents with one line in common are 44,850 pairs


def test_passages_meet_in_any_repeating_text(spark):
    """Texts of few words, full of repetition: whatever lies around equal runs of three words of two documents is found without meeting them all."""
    rng = random.Random(19)
    rows = []
    for i in range(40):
        w = []
        while len(w) < 60:
            w += [str(rng.randrange(40)) for _ in range(rng.randint(1, 3))] * rng.choice((1, 1, 4, 9, 14))
        w += rows[rng.randrange(i)][10:55] if i % 2 else []
        rows.append([x if rng.random() > 0.05 else str(rng.randrange(40)) for x in w])
    ids = [np.array([int(x) for x in w], np.uint16) for w in rows]
    due = set()
    for j, b in enumerate(ids):
        for i, a in enumerate(ids[:j]):
            met = [(x, y) for x, p in enumerate(passages.run_keys(a)) for y, q in enumerate(passages.run_keys(b)) if p == q]
            if any(passages.around(a, b, x, y) for x, y in met):
                due.add((j, i))
    docs = spark.createDataFrame([(i, bytearray(a.tobytes()), None) for i, a in enumerate(ids)], "id long, words binary, covered array<struct<start_word: int, end_word: int, identity: double>>")
    links = passages.chain_table(passages._candidates(docs), passages.SHORT, passages.AROUND, 1)
    found = passages._verified(links, docs.select("id", "words"), passages.MIN_WORDS, passages.IDENTITY, passages.AROUND, passages.around_parts).collect()
    assert len(due) > 15 and {(r.doc_id, r.source_doc_id) for r in found} == due


def test_every_exact_run_is_in_a_passage(spark):
    rng = random.Random(15)
    pool = [["".join(rng.choice("abcd") for _ in range(4)) for _ in range(rng.randint(8, 25))] for _ in range(14)]
    rows = [(i, [w for _ in range(rng.randint(3, 12)) for w in rng.choice(pool)]) for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    spans = defaultdict(list)
    for r in passages.repeated_passages(df).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    seen, n = set(), passages.MIN_WORDS
    for i, w in rows:
        own = [(tuple(w[s : s + n]), s) for s in range(len(w) - n + 1)]
        assert not [s for g, s in own if g in seen and not any(a <= s and s + n <= b for a, b in spans[i])]
        seen |= {g for g, _ in own}


def test_chains_and_distance_against_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        a = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 12))})
        best: list[float] = []
        for j, (x, y) in enumerate(a):
            steps = [best[i] - passages.GAP * (x - p + y - q) for i, (p, q) in enumerate(a[:j]) if p < x and q < y]
            best.append(passages.K + max([0.0, *steps]))
        out = passages.chains(a)
        assert sum(c[4] for c in out) == len(a)
        x0, x1, y0, y1, n = out[0]
        assert passages.K * n - passages.GAP * (x1 - passages.K - x0 + y1 - passages.K - y0) == pytest.approx(max(best))
    for _ in range(200):
        p, q = [np.array([rng.randrange(3) for _ in range(rng.randint(0, 9))]) for _ in range(2)]
        d = np.arange(len(q) + 1)
        for i in range(len(p)):
            d = np.array([e := i + 1] + [e := min(e + 1, d[j + 1] + 1, d[j] + (p[i] != q[j])) for j in range(len(q))])
        assert passages.distance(p, q, 20) == d[-1]
        assert passages.distance(p, q, 2) == min(d[-1], 3)
        assert passages._banded(p, q, 20) == d[-1]


def test_image_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):
        b = images._box(np.kron(rng.integers(0, 255, (12, 12)).astype(float), np.ones((12, 12))), 1)
        pictures = (b, b[24:130, 10:120], np.clip(b * 0.8 + 20, 0, 255), np.rot90(b).copy())
        rows += [(10 * k + i, images.encode_pgm(x)) for i, x in enumerate(pictures)]
    rows += [(900, None), (901, b""), (902, b"P5 junk"), (903, rows[0][1]), (904, images.encode_pgm(np.zeros((3, 3))))]
    got = {r.image_id: r for r in images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert {i: got[i].class_id for i in range(40) if i in got} == {i: i // 10 * 10 for i in range(40) if i in got}
    assert got[903].class_id == 0 and all(got[i].class_id == i for i in (900, 901, 902, 904))
    assert images.image_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_edited_copies_are_found(spark):
    """Recall of edits among many textures with few distinct corners, against all pairs by agree()."""
    rng = np.random.default_rng(6)
    rows, n = [], 40
    for k in range(n):
        b = images._box(np.kron(rng.integers(0, 255, (12, 12)).astype(float), np.ones((12, 12))), 1)
        edits = (b, b[20:128, 10:120], images.resize(b, 0.8), images.resize(b, 0.7), np.clip(b * 0.8 + 20, 0, 255), b + rng.normal(0, 4, b.shape), np.rot90(b).copy())
        rows += [(10 * k + i, images.encode_pgm(x)) for i, x in enumerate(edits)]
    twice = [*rows, rows[3], (None, rows[4][1])]
    df = spark.createDataFrame(twice, "image_id long, image binary").withColumns({"cell": F.lit(1), "hub": F.lit(2)})
    out = images.image_copies(df).collect()
    assert len(out) == len(twice) and [r.class_id for r in out if r.image_id is None] == [None]
    got = {r.image_id: r.class_id for r in out}
    described = {}
    for i, data in rows:
        spots, bits = images.describe(images.decode_pgm(data))
        described[i] = images._pack_spots(spots), bits.view(np.int64).ravel()
    for e in range(1, 7):
        true = [k for k in range(n) if images.agree(*described[10 * k], *described[10 * k + e])]
        assert sum(got[10 * k] == got[10 * k + e] for k in true) >= 0.9 * len(true) and len(true) >= (0.9 if e != 3 else 0) * n, e
    for i, j in {(i, got[i]) for i, _ in rows if got[i] // 10 != i // 10}:
        members = [m for m, c in got.items() if c == j and m is not None]
        assert any(images.agree(*described[a], *described[b]) for a in members for b in members if a // 10 != b // 10)


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, 60) for _ in range(4)), "en", "s", 0) for i in range(30)]
    rows += [(50, rows[0][1], "en", "s", 0), (51, None, "en", "s", 0), (52, "!!! 123", None, "s", 0), (53, rows[3][1] + " mail ann@x.org", None, "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert kept >= set(range(30)) and not kept & {50, 51, 52}
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert not docs.where("contains(text, 'ann@x.org')").count()
    for name in stages:
        assert stages[name](spark, empty(spark), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(31)
    line = lambda: prose(rng, 40)
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 5)))) for i in range(40)]
    long = prose(rng, 3000)
    rows += [(50, rows[4][1]), (51, rows[5][1] + "\n" + rows[6][1] + "\n" + line()), (52, long), (53, long.replace("river", "rivers", 1)), (54, None), (55, "12 !")]
    rows += [(60 + i, f"{line()} write to ann{i}@x.org or 10.0.0.{i}, +1 555 123 45{i}7 8") for i in range(6)]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", 0) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs)
    kept = [(i, t) for (i, t), (_, _, rejected) in zip(rows, model.predict([t for _, t in rows]), strict=True) if not rejected]
    kept = [(i, t) for i, t in dedup(kept, lines.MIN_LINES, lines.MIN_CHARS).items() if t.strip(" ") or t == dict(rows)[i]]
    fp = {i: simhash_of(t) for i, t in kept}
    alone = []
    for i in fp:
        reach, todo = {i}, [i]
        while todo:
            j = todo.pop()
            new = {k for k in fp if k not in reach and (fp[j] ^ fp[k]).bit_count() <= 4}
            reach |= new
            todo += new
        alone += [i] if min(reach) == i else []
    clean = {}
    for i in alone:
        out, at = "", 0
        for a, k, b in base_spans(dict(kept)[i]):
            out, at = (out + dict(kept)[i][at:a] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k], b) if a >= at else (out, max(at, b))
        clean[i] = out + dict(kept)[i][at:]
    assert not disclosing([(i, dict(kept)[i]) for i in alone], pii.SUPPORT, pii.KIND_SUPPORT, pii.GENERALISE)
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t in clean.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.update((i, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert {50, 53, 54, 55}.isdisjoint(clean) and {52, 60, 65} <= set(clean)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(16)
    a, b, c, d, e = (prose(rng, 200) for _ in range(5))
    rows = [(7, a), (7, b), (None, c), (None, d), (None, c), (None, c + " "), (8, a), (9, e), (9, e), (None, e)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert Counter((r.doc_id, r.text.strip()) for r in got) == Counter([(7, a), (7, b), (None, c), (None, d), (9, e)])
