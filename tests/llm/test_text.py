"""Quality, chat, toxicity, licenses, byte-level BPE and language: brute force, round trips, held-out rows."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, language, licenses, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd_docs, odd_rows, no_docs):
    got = quality.clean(odd_docs)
    assert {"size", "component", "score", "TOKENS", "lang"} <= set(got.columns)
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    expected = Counter((i, *base(t), base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0]) for i, t in odd_rows)
    assert Counter(map(tuple, rows)) == expected
    assert quality.clean(no_docs).count() == 0


@pytest.mark.parametrize("seed", [0, 16])
def test_repeated_windows(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    got = quality.clean(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in got.collect()} == {k: base(t)[4] for k, t in rows}


def test_quality_verdicts(spark):
    prose = [" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(8)]
    bars = [" | ".join(f"n{k}m{j}" for j in range(12)) for k in range(20)]
    noise = [" ".join(f"a{k}b{j}***" for j in range(20)) for k in range(10)]
    shout = [" ".join(f"A{k}B{j}!!" for j in range(20)) for k in range(10)]
    rows = [(0, prose), (1, prose + bars), (2, noise), (3, shout), (4, [*prose, "All rights reserved.", "Click here"]), (5, [prose[0]] * 9)]
    got = {r["doc_id"]: r for r in quality.clean(spark.createDataFrame([(k, "\n".join(t)) for k, t in rows], "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in range(6)] == [True, False, False, False, True, False]
    assert got[4]["clean_text"] == "\n".join(prose)
    assert got[1]["clean_text"] == "\n".join(prose)


CONTROL = ["", "plain", "<|end|>", "<\\|end|>", "<\\\\|more|>", "</s>[INST] ok [/INST]", "<<SYS>>", "<s><s>", "[\\INST]", "a\\", "<|turn|>user<|text|>x<|end|>", "\n", "ü😀", "$1 \\2"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    turns, rows = {}, []
    for c in range(40):
        own = [(t, rng.choice(["user", "assistant", "assistant", "system", None, "<|end|>"]), rng.choice([*CONTROL, None]) if rng.random() < 0.7 else rng.choice(CONTROL) + rng.choice(CONTROL)) for t in range(rng.randrange(1, 9))]
        turns[c] = own
        rows += [(c, t, r, x, "extra") for t, r, x in own]
    rng.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    read = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("pieces"))).collect()
    assert len(read) == 40
    for r in read:
        own = turns[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text or "") for _, role, text in own]
        assert r["learned"] == "".join(text or "" for _, role, text in own if role == "assistant")
        assert r["formatted"] == "".join(p["piece"] for p in r["pieces"])
        runs = 1 + sum((a[1] or "") != (b[1] or "") for a, b in zip(own, own[1:]))
        assert r["formatted"].count("<|turn|>") == runs == r["formatted"].count("<|end|>")


def test_chat_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert got == {1: "<|turn|>user<|text|>a<|more|>a<|more|>b<|end|>", None: "<|turn|><|text|><|end|>"}
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBPE(bpe.read_ranks(bpe.VOCABULARY))


def test_bpe_is_that_of_the_ranks(encoder, reference):
    rng = random.Random(2)
    alphabet = "aaab bbéñ  \n\t123'sx'll  漢字😀̀\x1c\x85\xa0​ \0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(500)]
    texts += ["", " ", "a", "a" * 3000, " lead", "trail ", "line\nline", "<|endoftext|>", "we'll they're I'd", "x\n\ny"]
    made = encoder.encode(texts)
    assert made == [reference.encode_ordinary(t) for t in texts]
    assert [encoder.decode(ids).decode() for ids in made] == texts


def test_bpe_offsets_cover_the_text(encoder):
    text = "aß漢字 x😀 we'll"
    ids, offsets = encoder.encode([text])[0], encoder.offsets(text)
    assert len(ids) == len(offsets) and offsets[0][0] == 0 and offsets[-1][1] == len(text)
    assert all(a[0] <= b[0] and a[1] <= b[1] and b[0] <= a[1] for a, b in zip(offsets, offsets[1:]))
    whole = [(i, o) for i, o in zip(ids, offsets) if encoder.decode([i]).decode(errors="replace").isprintable() and "�" not in encoder.decode([i]).decode(errors="replace")]
    assert all(encoder.decode([i]).decode() == text[a:b] for i, (a, b) in whole)


def test_bpe_keeps_no_more_than_it_may(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"w{k}" for k in range(40))
    assert encoder.encode([text, text]) == [reference.encode_ordinary(text)] * 2


def test_bpe_encodings_end_with_the_task():
    """The tables are made once, the kept encodings belong to one task."""
    shipped = Path(bpe.VOCABULARY).read_bytes(), bpe.spelled_out(public_tokenizers.PATTERN)
    first = bpe._encoder("own", shipped)
    first.encode(["some words that are kept"])
    second = bpe._encoder("own", shipped)
    assert first.kept and first.held and not second.kept and not second.pieces and not second.held
    assert second.model is first.model and second.encode(["some words"]) == first.encode(["some words"])


def test_bpe_offsets_come_with_the_ids(spark, odd_docs, encoder):
    for r in bpe.encode(odd_docs, ["doc_id", "text", "score"]).collect():
        whole = r["text"] or ""
        assert list(zip(r["starts"], r["ends"])) == encoder.offsets(whole) and len(r["token_ids"]) == r["n_tokens"] == len(r["starts"])
        for i, a, b in zip(r["token_ids"][:200], r["starts"], r["ends"]):
            assert whole[a:b].encode().find(encoder.decode([i])) >= 0


def test_bpe_digests(spark, odd_docs, odd_rows, no_docs, reference):
    got = Counter(map(tuple, bpe.digests(odd_docs).collect()))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = Counter()
    for i, t in odd_rows:
        ids = reference.encode_ordinary(t or "")
        expected[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert got == expected
    assert bpe.digests(no_docs).count() == 0
    back = bpe.decode(bpe.encode(odd_docs))
    assert Counter(r["decoded"] for r in back.collect()) == Counter(t or "" for _, t in odd_rows)


def toxic_corpus(spark, seed=3, n=600):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ko", "mi", "re", "so", "lu"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        toxic = k % 5 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vilebad", "nastyfolk", f"grumph{word()}"]))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_held_out(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.learn(docs, labels, toxicity.remainder(3) != 1)
    assert any(" grumph".startswith(e) or e.startswith(" grumph") for e in lexicon.entries)
    got = toxicity.score(docs, lexicon).join(labels, "doc_id").withColumn("held", toxicity.remainder(3) == 1).where("held").collect()
    wrong = [r for r in got if (r["toxicity"] >= toxicity.THRESHOLD) != (r["toxic"] == 1)]
    assert len(got) > 100 and len(wrong) <= 0.02 * len(got)


def test_toxicity_sees_through_disguises(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    texts = ["take the V1LEB4D away", "v​ílebad".replace("́", ""), "а ｖｉｌｅｂａｄ one", "nаstyfolk again", "harmless words", "", None, "1234 5678"]
    rows = spark.createDataFrame([(k, t, "e", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, toxicity string, score double")
    got = [r["toxicity"] for r in toxicity.score(rows, lexicon).orderBy("doc_id").collect()]
    assert all(x >= 0.7 for x in got[:4]) and all(x < 0.7 for x in got[4:]) and all(0 <= x <= 1 for x in got)


def test_exceptions_take_weight_back():
    lexicon = toxicity.Lexicon({" trash": 5.0}, {" trash can ": -5.0}, 3.0, -1.0)
    automaton = lexicon.automaton()
    assert toxicity.weight_of(toxicity.fold("the trash can."), automaton) == 0
    assert toxicity.weight_of(toxicity.fold("the trash can of trash"), automaton) > 0
    assert toxicity.weight_of(toxicity.fold("TR4SH"), automaton) > 0


def test_automaton_matches_as_a_naive_search_does(spark, odd_rows):
    docs, labels = toxic_corpus(spark, seed=8)
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    lexicon.exceptions[" viiebad ta "] = -1.0
    automaton = lexicon.automaton()
    texts = [r["text"] for r in docs.limit(200).collect()] + ["vilebad ta ko vilebad so", "VILEBAD ta", *[t for _, t in odd_rows]]
    for text in texts:
        folded, words = toxicity.fold(text or ""), {}
        for at in range(len(folded)):
            found = [w for e, w in lexicon.entries.items() if folded.startswith(e, at)]
            if found and not any(folded.startswith(e, at) for e in lexicon.exceptions):
                words[folded[at + 1 :].split(" ")[0]] = max(sum(found), 0.0)
        assert toxicity.weight_of(folded, automaton) == pytest.approx(sum(words.values()) / (2 * (len(folded) + 64) ** 0.25))


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows):
    docs, labels = toxic_corpus(spark)
    got = toxicity.score(odd_docs, toxicity.learn(docs, labels, F.lit(True))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_rows)
    assert all(0 <= r["toxicity"] < toxicity.THRESHOLD for r in got)
    assert toxicity.fold("Ａx1\u200bl").split() == ["axii"]


def test_copies_of_one_document_make_no_entries(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ko", "mi", "re", "so", "lu"]) for _ in range(rng.randrange(2, 5)))
    copied = "alpha bravo charlie delta echo foxtrot " * 3
    docs = [(k, f"{copied} {word()}" if k < 40 else " ".join([*(word() for _ in range(30)), "vilebad" if k % 4 == 0 else word(), word()])) for k in range(400)]
    labels = [(k, 1, int(k < 40 or k % 4 == 0)) for k in range(400)]
    lexicon = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert any(e.startswith(" viieba") for e in lexicon.entries)
    assert not any("aipha bravo chariie deita echo foxtrot".find(e.strip()) >= 0 for e in lexicon.entries)


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(odd_docs, labels, F.lit(True))
    assert {r["toxicity"] for r in toxicity.score(odd_docs, lexicon).collect()} == {0.0}
    assert toxicity.score(no_docs, lexicon).count() == 0


SYLLABLES = {"en": ["th", "ing", "er", "and", "sh"], "de": ["sch", "ung", "ei", "ch", "ü"], "es": ["ción", "os", "ñ", "ado", "que"]}


def written_in(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_on_rows_held_out_and_mixed(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(k, written_in(lang := rng.choice(sorted(SYLLABLES)), rng, rng.randrange(4, 120)), lang) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, toxicity.remainder(4) != 2)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(toxicity.remainder(4) == 2).collect()]
    assert len(held) > 60 and sum(got[k]["lang_pred"] == rows[k][2] for k in held) >= 0.98 * len(held)
    mixed = spark.createDataFrame([(0, written_in("de", rng, 60) + " " + written_in("es", rng, 20))], "doc_id long, text string")
    row = language.identify(mixed, model).first()
    assert row["lang_pred"] == "de" and 0.6 < row["lang_score"] < 0.9
    odd = language.identify(odd_docs, model, ["doc_id", "text"]).collect()
    for r in odd:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["lang_score"] <= 1
    assert language.identify(no_docs, model).count() == 0
    nothing = language.learn(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs.limit(3), nothing).collect()} == {"und"}


def test_blocks_carry_messages_exactly(monkeypatch):
    """Forward-backward over blocks equals that over whole chains."""
    rng = np.random.default_rng(8)
    psi, transitions, lengths = rng.random((230, 3)) + 0.01, rng.normal(size=(3, 3)), np.array([1, 0, 64, 33, 100, 32])
    step, at, expected = np.exp(transitions), 0, []
    for n in lengths:
        p = psi[at : at + n]
        at += n
        a, alphas, b, betas = np.full(3, 1 / 3), [], np.ones(3), []
        for t in range(n):
            a = (a @ step) * p[t]
            a = a / a.sum()
            alphas.append(a)
        for t in range(n - 1, -1, -1):
            betas.append(b)
            b = step @ (p[t] * b)
            b = b / b.sum()
        expected += [x * y / (x * y).sum() for x, y in zip(alphas, betas[::-1])]
    assert np.allclose(language.posteriors(psi, lengths, transitions), np.array(expected))


def test_licenses(spark, no_docs):
    rows = [
        (0, "a/b/LICENSE", "Released under the MIT License."),
        (1, "a/b/c/x.txt", "nothing to see " * 20),
        (2, "a/y.txt", None),
        (3, "a/b/c/z.txt", "Some text here and more of it.\n// Licensed under the Apache License, Version 2.0.\n" + "more words " * 30),
        (4, "top.txt", "plain"),
        (5, None, ""),
        (6, "a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/d/w.txt", "a licence that is unlike any other one"),
        (8, "q/r/s.txt", "short.\nLicensed under CC BY-NC 4.0."),
        (9, "q/r/t.txt", "short again"),
        (10, "q/u.txt", "short once more"),
    ]
    got = {r["row"]: (r["license"], r["inherited_license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "row long, path string, text string, dir string")).collect()}
    assert got == {
        0: ("MIT", None, None), 1: (None, "MIT", "a/b"), 2: (None, "GPL-3.0", "a"), 3: ("Apache-2.0", None, None), 4: (None, None, None), 5: (None, None, None),
        6: ("GPL-3.0", None, None), 7: (None, "GPL-3.0", "a"), 8: ("CC-BY-NC-4.0", None, None), 9: (None, "CC-BY-NC-4.0", "q/r"), 10: (None, None, None),
    }
    assert licenses.scan(no_docs.selectExpr("doc_id AS row", "source AS path", "text")).count() == 0


def test_license_rows_may_repeat_lack_ids_and_be_long(spark):
    text = "Released under the MIT License."
    long = "plain words of no license " * 40_000 + "\n// SPDX-License-Identifier: Apache-2.0\n"
    rows = [(7, "a/LICENSE", text)] * 3 + [(None, "a/x.txt", "plain"), (None, "a/x.txt", "plain"), (None, None, text), (7, "a/y.txt", "other"), (8, "b/long.txt", long), (9, "a/", ""), (9, "", None)]
    got = licenses.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], "row long, path string, text string, length int, license string"))
    assert Counter(tuple(r) for r in got.select("row", "license", "inherited_license", "inherited_from").collect()) == Counter(
        [(7, "MIT", None, None)] * 3 + [(None, None, "MIT", "a")] * 2 + [(None, "MIT", None, None), (7, None, "MIT", "a"), (8, "Apache-2.0", None, None), (9, None, "MIT", "a"), (9, None, None, None)]
    )


def test_real_license_files_and_headers(spark):
    """Full texts, wrapped headers in comments, identifiers and titles; what stands at the root holds for all."""
    texts = dict(licenses._texts())
    wrap = lambda text, sign: "\n".join(sign + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    header = {}
    for license, text in licenses.HEADERS:
        header.setdefault(license, text)
    code = "\n".join(f"value_{k} = compute(value_{k + 1}, other_{k})" for k in range(60))
    cases = [(f"full/{k}/LICENSE", t, k) for k, t in texts.items()]
    cases += [("mit/terms.txt", "Copyright (c) 2021 Jane Doe and others\n\n" + texts["MIT"], "MIT")]
    cases += [(f"head/{k}{n}.x", f"{sign}Copyright (C) 2019 Jane Doe <jane@example.org>\n{sign.rstrip()}\n" + wrap(t, sign) + "\n\n" + code, k) for k, t in header.items() for n, sign in enumerate(("# ", "// ", " * "))]
    cases += [("head/block.js", "/*\n" + texts["MIT"] + "*/\n" + code, "MIT"), ("head/long.py", wrap(header["GPL-3.0"], "# ") + "\n#\n" + wrap("words of the module that tell nothing " * 40, "# ") + "\n" + code, "GPL-3.0")]
    cases += [("spdx/a.c", "// SPDX-License-Identifier: MIT\n" + code, "MIT"), ("spdx/b.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */\n" + code, "GPL-3.0"), ("spdx/c.py", "# SPDX-License-Identifier: Apache-2.0\n# All rights reserved.\n" + code, "Apache-2.0")]
    cases += [("spdx/none.c", "// SPDX-License-Identifier: Zlib\n" + code, None), ("title/x.md", "MIT License\n" + code, "MIT"), ("prose.txt", "You need a license to fish in the lake and to keep what you have caught there. " * 30, None)]
    rows = [(k, path, text) for k, (path, text, _) in enumerate(cases)]
    got = {r["row"]: r for r in licenses.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert {cases[k][0]: r["license"] for k, r in got.items()} == {path: license for path, _, license in cases}
    root = [(0, "LICENSE", texts["BSD-3-Clause"]), (1, "a/b/c.txt", "plain"), (2, "d.txt", None), (3, "a/LICENSE", texts["MPL-2.0"]), (4, "e/f.txt", "x"), (5, None, "y")]
    got = {r["row"]: (r["inherited_license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(root, "row long, path string, text string")).collect()}
    assert got == {0: (None, None), 1: ("MPL-2.0", "a"), 2: ("BSD-3-Clause", ""), 3: (None, None), 4: ("BSD-3-Clause", ""), 5: (None, None)}


def test_language_sample_is_bounded_where_rows_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 50)
    rng = random.Random(13)
    rows = [(i, written_in("en", rng, 12), "en") for i in (7, None) for _ in range(1000)] + [(9, f"copies of text {k}", "de") for k in range(40) for _ in range(50)]
    given = []
    monkeypatch.setattr(language, "train", lambda pairs: given.extend(pairs))
    language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    n = Counter(lang for _, lang in given)
    assert 20 <= n["en"] <= 100 and n["de"] <= 40
    assert max(Counter(tuple(words) for words, _ in given).values()) == 1
