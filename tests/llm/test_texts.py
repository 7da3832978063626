"""Operators that work row by row: media, bytes pairs, personal data, language, quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cdrspark.llm import bpe, langid, media, pii, quality
from cdrspark.llm.common import id_remainder
from tests.llm import odd

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def by_id(df, key="doc_id"):
    return {(r[key], i): r for i, r in enumerate(sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0)))}


# -- byte pairs -----------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode_table(odd.table(spark).withColumn("kept", F.col("text")), VOCABULARY, with_ids=True, with_decoded=True).collect()
    assert len(got) == len(odd.rows())
    for r in got:
        ids = lib.encode(r["kept"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_bpe_random_texts():
    lib, own = Tokenizer.from_file(VOCABULARY), bpe.WordEndBpe(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(4)
    letters = "abcdefghaaaeee  ..,'-_ÀÉßİΣ́　\x85\x1c1½٣日😀<|endoftext|>\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|>" * 3, "x<|startoftext|>'s'S", "th" * 400]
    for text, (ids, tokens) in zip(texts, own.encoded(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert tokens == lib.decode(want, skip_special_tokens=False)


def test_bpe_memory_limit(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, fresh = (bpe.WordEndBpe(open(VOCABULARY, encoding="utf-8").read()) for _ in range(2))
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma", "x" * 70]) + str(rng.randrange(30)) for _ in range(30)) for _ in range(3)]
        fresh.ids_of.clear()
        fresh.tokens_of.clear()
        assert own.encoded(texts) == fresh.encoded(texts)


def test_bpe_clashing_and_empty(spark):
    clash = odd.table(spark).withColumn("n_tokens", F.lit("old")).withColumn("ids", F.lit(1))
    assert dict(bpe.encode_table(clash, VOCABULARY).dtypes)["n_tokens"] == "bigint"
    assert bpe.encode_table(odd.empty(spark), VOCABULARY).count() == 0


# -- media ----------------------------------------------------------------------------------


def test_media_round_trip(spark):
    got = media.read_back(media.stored(odd.table(spark).select("doc_id", "text").withColumn("media", F.lit("clash")))).collect()
    want = {}
    for doc, text, *_ in odd.rows():
        n, payload = media.payload_of(text)
        data = media.as_media(payload)
        want.setdefault(doc, []).append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest()))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:7])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert media.read_back(media.stored(odd.empty(spark).select("doc_id", "text"))).count() == 0
    same = [r["feature"] for r in got if r["n_bytes"] == 4]
    assert len(same) == 3 and len(set(same)) == 1


def test_media_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (6, 3, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_netpbm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_netpbm(colour)), colour)
    assert np.array_equal(media.decode(media.encode_bmp(colour)), colour)
    assert np.array_equal(media.decode(b"P2 # a\n2 1\n# b\n15\n0 15"), [[0, 255]])
    assert np.array_equal(media.decode(b"P1\n3 1\n1 01"), [[0, 255, 0]])
    assert np.array_equal(media.decode(b"P4\n3 2\n\x40\xa0"), [[255, 0, 255], [0, 255, 0]])
    assert np.array_equal(media.decode(b"P5 2 1 65535\n\x00\x00\xff\xff"), [[0, 255]])
    for bad in (b"", b"P9", b"P5 2 2 255\nab", b"BM", b"P5 x", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_of_areas():
    a = np.random.default_rng(1).integers(0, 256, (11, 7)).astype(np.uint8)
    for h, w in ((8, 9), (3, 2), (20, 16), (11, 7)):
        want = np.zeros((h, w))
        for i in range(h):
            for j in range(w):
                y, x = (np.clip(np.minimum(np.arange(n) + 1, (k + 1) * n / m) - np.maximum(np.arange(n), k * n / m), 0, None) for n, k, m in ((11, i, h), (7, j, w)))
                want[i, j] = (np.outer(y, x) * a).sum() / (y.sum() * x.sum())
        assert np.allclose(media.area_resize(a, h, w), want)


def test_resize_and_hash_by_bands(monkeypatch):
    """Bands of any height give one result; hashes are comparisons of plain means of areas."""
    rng = np.random.default_rng(2)
    for shape in ((16, 18), (23, 40, 3), (8, 9), (3, 5), (1, 64), (200, 64, 3)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        whole = media.area_resize(pixels, 8, 9)
        for rows in (1, 3, 7):
            monkeypatch.setattr(media, "BAND_ROWS", rows)
            assert np.allclose(media.area_resize(pixels, 8, 9), whole, rtol=1e-10)
        monkeypatch.setattr(media, "BAND_ROWS", 4096)
        fine = np.repeat(np.repeat(media.grey(pixels), 8, axis=0), 9, axis=1)  # every output pixel covers whole fine ones
        small = fine.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3)).round(6)
        bits = [small[y, x + 1] > small[y, x] for y in range(8) for x in range(8)]
        assert media.difference_hash(pixels) == sum(int(b) << (63 - i) for i, b in enumerate(bits))


def test_tiles_of_undecodable_files(spark):
    files = spark.createDataFrame([(1, bytearray(media.encode_netpbm(np.eye(9, dtype=np.uint8) * 255))), (2, bytearray(b"junk")), (3, None)], "id int, media binary")
    got = {r["id"]: r for r in media.tiles(files).collect()}
    assert got[2]["tile"] is None and got[3]["dhash"] is None
    assert bytes(got[1]["tile"])[:6] == b"\x93NUMPY" and (got[1]["width"], got[1]["planes"]) == (9, 1)


# -- personal data --------------------------------------------------------------------------


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(8)
    texts = ["".join(rng.choice("a1.@+- 0(9)%b") for _ in range(rng.randrange(80))) for _ in range(5000)]
    parts = ["1", ".", "12", "255", "@", "a", "256", "0300", " ", "4111111111111111", "+1", "(", "-", "x.y", "é"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000, "+1 " + "(" * 200_000):
        pii.base_spans(t)


SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def trained():
    return pii.learn([
        f"Call +1 (375) 555-43{i:02d} now. Card {'4111111111111111' if i % 2 else '4012888888881881'} mail a{i}.b@x.com host 10.20.30.{i}. We sold {i} of {i * 7} in 20{i:02d}. "
        f'Order 40000000000000{i} of {i % 7}.{i % 3}, token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then.'
        for i in range(10, 90)
    ])


#: Texts and what the field adds to their base spans.
MENTIONS = (
    ("Call +1 (375) 555-4393 now or (375) 555-4393 later, card 4111111111111111 and 4111.1111.1111.1111, and 12 items in 2024.", {("phone", "(375) 555-4393"), ("card", "4111.1111.1111.1111")}),
    ("card 5105105105105100, then 5105105105105190 with a slip", {("card", "5105105105105190")}),
    (f'token = "{SECRET}" and then {SECRET}.', {("secret", SECRET)}),
    ("commit abcdef1234567890abcdef1234567890abcdef12 and no name", set()),
    ("number 1234567890123456 twice 1234567890123456", set()),
    ("order 5927243074273351 of " * 7, set()),
    ("In 2024 we sold 12 of 4111 items; 12 of 4111 again, version 1.2.3 and 1.2.3 at 10:30, 10:30.", set()),
    ("no digit at all", set()),
    ("", set()),
    (None, set()),
)


def test_skip_chain_marks_repeats_and_leaves_clean_texts():
    for text, want in MENTIONS:
        ((base, added),) = pii.find([text or ""], trained())
        assert base == plain_spans(text or "")
        assert {(pii.LABELLED[k], text[s:e]) for s, k, e in added} == want, text


def test_hidden_mentions_are_found():
    """Of each entity a second mention that no pattern sees: most are found, and numbers of the same looks aren't."""
    field, rng = trained(), random.Random(4)
    found = wrong = 0
    for _ in range(200):
        n = [rng.randrange(10) for _ in range(16)]
        card = next("".join(map(str, [*n[:15], d])) for d in range(10) if pii.luhn("".join(map(str, [*n[:15], d]))))
        phone = f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        decoy = next(x for x in (str(rng.randrange(10**15, 10**16)) for _ in range(99)) if not pii.luhn(x))
        ((_, added),) = pii.find([f"card {card} and phone +1 {phone} so far, {decoy} is the order. Again {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} or {phone} here, order {decoy} or"], field)
        found += sum(k in (2, 3) for _, k, _ in added)
        wrong += len(added) > 2
    assert found >= 360 and wrong <= 4


def some_field(rng):
    pair = lambda: (lambda m: m + m.T)(rng.normal(size=(pii.LABELS, pii.LABELS)))
    square = rng.normal(size=(2, pii.LABELS, pii.LABELS))
    return pii.Field(rng.normal(size=(len(pii.FEATURES), pii.LABELS)), square[0], square[1], pair(), pair())


def test_marginals_equal_enumeration_on_a_tree():
    field = some_field(np.random.default_rng(0))
    g = pii.graph(["1111 2222 aaa 1111 bbb 5551234567 ccc 1234567"], [[]])
    assert g.chain.tolist() == [[0, 1]] and g.equal.tolist() == [[0, 2]] and g.similar.tolist() == [[3, 4]] and len(g.doc) == 5
    own = field.own(g)
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None] + field.chain[:, :, None] + field.equal[:, None, :])
    want = np.stack([joint.sum(axis=tuple(b for b in range(3) if b != a)) for a in range(3)])
    pair = np.exp(own[3][:, None] + own[4][None] + field.similar)
    want = np.concatenate([want / want.sum(axis=1, keepdims=True), [pair.sum(axis=1) / pair.sum(), pair.sum(axis=0) / pair.sum()]])
    assert np.allclose(field.marginals(g, rounds=60), want, atol=1e-4)
    assert np.allclose(field.marginals(g, rounds=60, together=2), want, atol=1e-4)


def test_learning_reaches_a_minimum():
    """Weights of one label less another grow with evidence for it, and equal evidence gives equal weights again."""
    a, b = trained(), trained()
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("unary", "pattern", "chain", "equal", "similar"))
    assert all(a.pattern[k, k] > a.pattern[k, 0] for k in range(1, pii.LABELS))
    assert all(len(set(np.round(t[~np.eye(pii.LABELS, dtype=bool)], 12))) == 1 and len(set(np.round(np.diag(t), 12))) == 1 for t in (a.equal, a.similar))
    assert all(a.equal[k, k] > a.equal[k, 0] + 3 and a.similar[k, k] > a.similar[k, 0] + 3 for k in range(1, pii.LABELS))


def test_one_edit():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("01") for _ in range(rng.randrange(5))) for _ in range(2))
        near = {a[:i] + c + a[j:] for i in range(len(a) + 1) for j in (i, i + 1) for c in ("", "0", "1") if j <= len(a)} - {a}
        assert pii.one_edit(a, b) == (b in near)


def test_pii_table(spark):
    field = pii.learn(pii.sample(odd.table(spark)))
    got = pii.detect(odd.table(spark).withColumn("spans", F.lit(1)), field)
    assert got.count() == len(odd.rows())
    none = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in got.collect()} == {none}
    assert pii.detect(odd.empty(spark), pii.learn([])).count() == 0


def test_personal_data_in_a_table(spark):
    """Every column from plain patterns and the listed mentions; repeated rows, null ids, names that clash."""
    more = "ip 10.20.30.40 a.b@c.de +49 (30) 123-4567 or 4111-1111-1111-1111; 1.2.3.4 z@y.xw é 日本 5.6.7.8"
    rows = [(i, t, w) for i, (t, w) in enumerate([*MENTIONS, (more, set())])] * 2 + [(None, more, set())]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, n_email string").withColumns({"spans": F.lit(5), "uid": F.lit("keep")})
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"], r["n_added"], r["n_spans"], r["uid"]) for r in pii.detect(table.repartition(3), trained()).collect())
    want = Counter()
    for i, t, w in rows:
        text, base = t or "", plain_spans(t or "")
        own = [(s, k, e) for s, k, e in base]
        added = []
        for kind, value in w:
            k = pii.LABELLED.index(kind)
            places = [m.start() for m in re.finditer(re.escape(value), text)]
            added += [(s, k, s + len(value)) for s in places if not any(bs < s + len(value) and be > s for bs, _, be in own)]
        joined = lambda spans: ",".join(f"{pii.LABELLED[k]}:{s}:{e}" for s, k, e in sorted(spans))
        counts = [sum(k == j for _, k, _ in own) for j in range(4)]
        want[(i, *counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(own + added), len(added), len(own) + len(added), "keep")] += 1
    assert got == want


def test_sample_is_full_where_few_rows_have_digits(spark):
    text = F.when(F.col("id") % 100 == 0, F.concat(F.lit("call "), F.col("id").cast("string"))).otherwise(F.lit("nothing to see"))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert len(pii.sample(docs)) == 400
    copies = docs.filter("doc_id % 100 <> 0").select("doc_id", F.lit("page 7").alias("text")).unionByName(docs)
    assert len(pii.sample(copies)) == 400


# -- language -------------------------------------------------------------------------------


def test_gru_gradients():
    net = langid.fresh(["a", "b"], 3, 1)
    for group in (net.inputs, net.states, net.labels):
        group[:] = [p.astype(np.float64) for p in group]
    net.bias = net.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    codes, used, label = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([6, 4, 6, 2]), np.array([0, 1, 0, 1])
    _, grads = langid.gradients(net, codes, used, label)
    for p, g in zip(net.params(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[::11][:60]:
            old = p[at]
            ends = []
            for step in (1e-3, -1e-3):
                p[at] = old + step
                ends.append(langid.gradients(net, codes, used, label)[0])
            p[at] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - g[at]) < 1e-5


def test_languages(spark):
    docs = odd.table(spark)
    net = langid.train(langid.sample(docs), steps=120)
    rows = langid.identify(docs.withColumn("score", F.lit("clash")), net, keep=True).collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and (r["doc_id"] < 30 or 100 <= r["doc_id"] < 130):
            assert r["lang_pred"] == ("en" if r["doc_id"] < 30 else "fr")
    assert langid.sample(odd.empty(spark)) == []
    untrained = langid.identify(docs, langid.train([])).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}
    assert langid.identify(odd.empty(spark), net).count() == 0


def whole_scan(net, text):
    """Probabilities of one document by plain recurrences over all its bytes."""
    h_n, states = net.hidden, []
    for way in (0, 1):
        h, out = np.zeros(h_n), []
        for byte in text if way == 0 else reversed(text):
            x, g = net.inputs[way][byte].astype(float), net.states[way].astype(float) @ h
            r, z = (1 / (1 + np.exp(-(x[i * h_n : (i + 1) * h_n] + g[i * h_n : (i + 1) * h_n]))) for i in (0, 1))
            n = np.tanh(x[2 * h_n :] + r * g[2 * h_n :])
            h = (1 - z) * n + z * h
            out.append(h)
        states.append(out if way == 0 else out[::-1])
    total = np.zeros(len(net.languages))
    for f, b in zip(*states, strict=True):
        e = np.exp(net.labels[0] @ f + net.labels[1] @ b + net.bias[:, 0])
        total += e / e.sum()
    return total / max(1, len(text))


def test_documents_equal_whole_scans(spark):
    """Whatever the windows: exact for texts that margins cover, nearly so for longer ones of a trained network."""
    net = langid.fresh(["a", "b", "c"], 5, 3)
    texts = [b"x", b"some text " * 40, b"", b"y" * 128, b"z" * 129, b"abc de " * 21, b"q" * 160]
    together = net.documents(texts)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(net.documents([t])[0], p, atol=1e-6)
        assert not t or abs(p.sum() - 1) < 1e-5
        if len(t) <= langid.WINDOW + langid.MARGIN:
            assert np.allclose(whole_scan(net, t), p, atol=1e-4)
    trained = langid.train(langid.sample(odd.table(spark)), steps=120)
    for r in odd.rows()[::7]:
        text = (r[1] or "").encode()[:3000]
        assert np.allclose(whole_scan(trained, text), trained.documents([text])[0], atol=5e-3)


def test_training_windows_keep_all_bytes():
    net = langid.train([("ж" * 128, "ru"), ("a" * 128, "en")] * 20, steps=40)
    assert net.languages == ["en", "ru"] and net.documents(["жжж".encode(), b"aaa"]).argmax(axis=1).tolist() == [1, 0]


def test_language_accuracy_on_held_out_documents(spark):
    from cdrspark.llm.langid import op10_langid_bigru

    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = op10_langid_bigru(spark, d).join(truth, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


# -- quality --------------------------------------------------------------------------------


def plain_statistics(text):
    """The statistics by counting characters and words one by one."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), max(1, len(text))
    raw = text.encode()
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))
    upper = sum(65 <= c <= 90 for c in raw)
    latin = sum(a == 0xC3 and 0x80 <= b <= 0x9E for a, b in zip(raw, raw[1:], strict=False))
    letters = upper + sum(97 <= c <= 122 for c in raw) + (sum(c >= 128 for c in raw) + 1) // 2
    rest = sum(33 <= c <= 126 and not chr(c).isalnum() and c not in (44, 46) for c in raw)
    triples = list(zip(words, words[1:], words[2:], strict=False))

    def logit(part, whole, usual, weight):
        share = min(max((part + usual * weight) / (whole + weight), 0), 1) * 0.998 + 0.001
        return math.log(share / (1 - share))

    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), logit(upper + latin, letters, 0.03, 60), logit(letters, chars, 0.8, 60),
        logit(sum(48 <= c <= 57 for c in raw), chars, 0.002, 120), logit(text.count(".") + text.count(","), n, 0.15, 10), logit(text.count("!"), n, 0, 10),
        logit(text.count("|"), n, 0, 10), logit(rest, chars, 0.002, 120), math.log1p(len(words) / len(lines)), logit(len(set(words)), n, 0.8, 20),
        logit(max(Counter(words).values(), default=0), n, 0.05, 20), logit(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, 0.005, 20),
        logit(len(triples) - len(set(triples)), len(triples), 0.01, 20), logit(len(lines) - len(set(lines)), len(lines), 0.02, 5),
    ]


def test_statistics_equal_plain_counts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cC.,!|9\n é ÀÿЖ日#") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [" ".join(rng.choice(("a", "b", "the")) for _ in range(50)), None, "", "one", *[r[1] for r in odd.rows()]]
    for t in texts:
        assert np.allclose(quality.statistics(t), plain_statistics(t), rtol=1e-12), repr(t)


def test_labels_that_train(spark):
    """Null labels and others than 0 and 1 are left out, several labels of a document count once each."""
    table = quality.vectors(spark.createDataFrame([(i, f"text {i} " * (1 + i % 5)) for i in range(40)], "doc_id long, text string"))
    good = [(i, i % 2) for i in range(40)] + [(3, 0)]
    made = lambda rows: quality.train(table.join(spark.createDataFrame(rows, "doc_id long, label int"), "doc_id"))
    a, b = made(good), made([*good, (1, None), (2, 7), (5, -1)])
    x = np.array([r["stats"] for r in table.collect()])
    assert np.allclose(a.scores(x), b.scores(x)) and not np.allclose(a.scores(x), made(good[:-1]).scores(x))
    ids = [r["doc_id"] for r in table.collect()]
    counts = [np.array([x[ids.index(i)] for i, lab in good if lab == k]) for k in (0, 1)]
    assert np.allclose(quality.fit({k: quality.moments(v) for k, v in enumerate(counts)}).scores(x), a.scores(x))


def test_quality_table(spark):
    docs = odd.table(spark).withColumn("stats", F.lit("clash")).withColumn("score", F.lit(3))
    table = quality.vectors(docs)
    labelled = table.filter("doc_id is not null").withColumn("label", (F.col("doc_id") < 100).cast("int"))
    model = quality.train(labelled)
    rows = quality.score(table, model).collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (205, 206)}) == 1
    assert quality.score(quality.vectors(odd.empty(spark)), model).count() == 0
    nobody = quality.train(labelled.filter("false"))
    assert {r["score"] for r in quality.score(table, nobody).collect()} == {0.5}


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {k: rng.normal(size=(200, d)) * (1 + k) + k for k in (0, 1)}
    model = quality.fit({k: quality.moments(v) for k, v in x.items()}, to_pooled=0.0, to_diagonal=0.0, floor=0.0)
    point = rng.normal(size=(5, d))
    logs = []
    pooled = sum(np.cov(v.T, bias=True) for v in x.values()) / 2
    for v in x.values():
        lean = d / (d + 200)
        cov = (1 - lean) * np.cov(v.T, bias=True) + lean * pooled
        gap = point - v.mean(axis=0)
        logs.append(-0.5 * np.einsum("nd,de,ne->n", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op4_quality_qda(spark, d).filter("held_out").join(labels, "doc_id")
    assert got.filter("predicted = quality").count() / got.count() > 0.93


def test_remainders(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,), (-3,)], "doc_id long").select("doc_id", id_remainder(F.col("doc_id"), 5).alias("r"))
    for r in rows.collect():
        assert r["r"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5
