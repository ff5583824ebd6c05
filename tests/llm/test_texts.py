"""Operators that judge a text by itself: brute force, edge cases, clashing columns."""

import collections
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from sentryframe.llm import decontaminate, langid, pieces, quality, secrets
from sentryframe.llm.queries import model_file

from .builders import awkward, clashing, documents, prose

WORD7 = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_found(doc, items, window=10):
    """Every window at every place."""
    words = WORD7.findall((doc or "").encode().lower())
    hit, named = set(), set()
    for item, text in items:
        parts = WORD7.findall((text or "").encode().lower())
        size = min(window, len(parts))
        for s in range(len(parts) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == parts[s:s + size]:
                    hit.update(range(at, at + size))
                    named.update([str(item)] if item is not None else [])
    return len(words), len(hit), sorted(named)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(i, n, ["alpha", "beta", "Gamma", "d3"])) for i, n in enumerate((14, 10, 3, 1, 0, 12, 12))]
    items += [(20, items[0][1]), (21, None), (22, "Größe, straße: ÄÖ"), (None, "alpha beta")]
    texts = [prose(100 + i, rng.randint(0, 60), ["alpha", "beta", "gamma", "d3"]) for i in range(40)]
    texts += [items[0][1].upper() + "!", "x " + items[5][1].replace(" ", "--"), "große größe STRAßE ÄÖ", None, ""]
    docs = clashing(documents(spark, texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (8 << 20, 40):  # one block, and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"]))
               for r in decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
        assert got == {i: windows_found(t, items) for i, t in enumerate(texts)}


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    log = []
    send, cut = decontaminate.send, decontaminate.cut
    monkeypatch.setattr(decontaminate, "send", lambda s, block: log.append(len(block.rows)) or send(s, block))
    monkeypatch.setattr(decontaminate, "cut", lambda df: log.append("written") or cut(df))
    items = [(i, f"w{i} x{i} y{i}") for i in range(12)]
    docs = documents(spark, [text for _, text in items] + [" ".join(text for _, text in items)])
    got = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=32)
    assert log[1::2] == ["written"] * (len(log) // 2) and len(log) > 5 and sum(log[::2]) == 12
    assert {r["doc_id"]: (r["n_hit"], len(r["item_ids"])) for r in got.collect()} == {**{i: (3, 1) for i in range(12)}, 12: (36, 12)}


def test_decontamination_takes_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    rows = decontaminate.find_contamination(docs, bench).collect()
    assert len(rows) == docs.count() and sum(r["n_hit"] for r in rows) == 2
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["a\n\na\n a\nb\nb\n", "x " * 8, "x " * 9, "one two three four five six seven eight " * 2 + "nine", None, "", "é日 <|>\u00a0b"]
    got = quality.measure(clashing(documents(spark, texts))).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got} \
        == {i: measures(t) for i, t in enumerate(texts)}
    assert quality.measure(awkward(spark)).count() == awkward(spark).count()
    assert quality.measure(documents(spark, [])).count() == 0


def test_ablation_counts_what_a_rule_rejects_alone(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (4,), (5,)], "fail_bits long")
    got = {(r["policy"], r["rule"]): (r["n_fail"], r["n_only"], r["n_rows"]) for r in quality.ablate(ledger).collect()}
    assert got["v1", "few_words"] == (4, 3, 7)  # bits 1, 1, 5 fail it alone under v1, 3 not
    assert got["v2", "few_words"] == (4, 2, 7)
    assert got["v2", "symbols"] == (2, 1, 7)


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_base_secrets_equal_the_plain_patterns(spark):
    hexa, key = "0123456789abcdef0123456789ab", "AKIA" + "ABCD1234" * 2
    texts = [
        f'é token = "{hexa}" x', f"PassWord:'abc' secret=abcdef {key}", f"日本 {key}AKIA{hexa}", "token=abc token==abcdef apikey : Zz9+/_.=-",
        f"ſecret = abcdefgh api_key= {hexa[:23]}g", f"{hexa}{hexa}g{hexa}", None, "", f"tokentoken:{key}", 'secret"  =  "abcdef', "passwd=日abcdef",
    ]
    got = secrets.find_secrets(clashing(documents(spark, texts))).select(
        "doc_id", secrets.span_text(secrets.by_start(F.col("base"))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: base_spans(t) for i, t in enumerate(texts)}
    assert secrets.find_secrets(awkward(spark)).count() == awkward(spark).count()
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_learned_format_finds_its_like_and_leaves_words(spark):
    rng = random.Random(9)
    value = lambda: "zk" + "".join(rng.choice("0123456789") for _ in range(8)) + "-" + "".join(rng.choice("ABCDEF") for _ in range(8))
    texts = [f"token = {value()} and text" for _ in range(80)] + [f"see {value()} here", "see some-ordinary-long-words-2024 here"]
    found = {r["doc_id"]: [s["value"] for s in r["learned"]] for r in secrets.find_secrets(documents(spark, texts)).collect()}
    assert len(found[80]) == 1 and found[80][0].startswith("zk") and not found[81]


def test_learned_formats_of_short_values_and_of_letters(spark):
    rng = random.Random(10)
    words = [f"{a}{b}{c}{d}" for a in ("over", "under", "inter") for b in ("stand", "work", "view") for c in ("ing", "ed", "able") for d in ("", "ness", "ly")]
    for letters, n, prefix in ((string.digits, 6, "zk"), (string.ascii_uppercase, 12, ""), (string.ascii_letters + string.digits, 14, "")):
        value = lambda: prefix + "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        plain = [value() for _ in range(20)]
        texts = [f"token = {value()} and text" for _ in range(200)] + [f"see {v} here" for v in plain] + [" ".join(words)]
        found = {r["doc_id"]: [s["value"] for s in r["learned"]] for r in secrets.find_secrets(documents(spark, texts)).collect()}
        assert sum(found[200 + i] == [v] for i, v in enumerate(plain)) >= 18 and found[220] == []


def test_language_profiles_on_held_out_rows(spark):
    one = prose(1, 1)
    vocabularies = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "schön", "nicht", "ich"], "cc": ["él", "los", "ción", "que", "año"]}
    texts, langs = [], {}
    for i in range(300):
        name = ("aa", "bb", "cc")[i % 3]
        texts.append(prose(i, 5 + i % 40, vocabularies[name]))
        langs[i] = name
    docs = clashing(documents(spark, [*texts, None, "", "123 !!! ²", one], langs))
    profiles = langid.learn(docs, ~langid.held_out())
    got = {r["doc_id"]: r for r in langid.identify(docs, profiles).collect()}
    held = {r["doc_id"] for r in docs.where(langid.held_out()).select("doc_id").collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in held if i < 300)
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[303]["lang_pred"] in vocabularies
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(awkward(spark), profiles).count() == awkward(spark).count()
    nothing = langid.learn(docs.limit(0), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    profiles = langid.Profiles({"a": [10, 11, 12], "b": [12, 11, 10]}, 3)
    import numpy as np
    name, score = profiles.judge(np.array([10, 11, 99]), np.array([5, 4, 3]))
    assert name == "a" and score == pytest.approx(1 - 3 / 9)  # in place, in place, unknown


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    rng = random.Random(2)
    alphabet = "abcdeth onsr  ▁é日\n1:=<x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" " * 33, "a" + " " * 40 + "b  ", "<0x0A><s></s><unk>", "a" * 5000, "ab" * 300, "\x00\x01", "😀日本語" * 20, prose(4, 500), ""]
    docs = clashing(documents(spark, [*texts, None]))
    encoded = pieces.encode(docs, model_file())
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {**{i: library.encode(t) for i, t in enumerate(texts)}, len(texts): None}
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(encoded, model_file()).collect()}
    assert back == {**{i: library.decode(library.encode(t)) for i, t in enumerate(texts)}, len(texts): None}
    assert pieces.encode(awkward(spark), model_file()).count() == awkward(spark).count()


def test_lattice_window_is_bounded():
    encoder = pieces.Encoder(pieces.Vocabulary(model_file()))
    assert "".join(encoder.lattice("ab" * 20_000)) == "ab" * 20_000
    assert encoder.widest <= 3 * encoder.v.longest


def test_items_digest_of_nothing(spark):
    row = spark.range(1).select(decontaminate.items_digest(F.array().cast("array<string>")).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"").hexdigest()
