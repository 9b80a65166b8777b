"""SimHash, decontamination, quality, PII, toxicity and the pipeline against brute force and known answers."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, pii, quality, simhash, toxicity
from spindrift.llm.common import let


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash_equals_brute_force(documents, clashing, empty):
    for df in (documents, clashing):
        rows = df.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r.text) for r in rows]
        label = brute_components(fps, 4)
        least = {c: min((r.doc_id for r, k in zip(rows, label) if k == c and r.doc_id is not None), default=None) for c in label}
        want = sorted(((r.doc_id, f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, label)), key=repr)
        assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shard", [8192, 7])
def test_links_in_tiles_lose_nothing(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centre for _ in range(12)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    got = {x.node: x.label for x in simhash.components(edges).collect()}
    label = brute_components(fps, 4)
    want = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(signed[i])
    have = {}
    for x in signed:
        have.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_bk_trees_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 16, 400, dtype=np.uint64)
    group = np.repeat([3, 9], 200)
    forest = simhash.BKForest(fps, group)
    got = {(int(q), int(n)) for a, b in forest.within(fps, np.repeat([0, 1], 200), 3) for q, n in zip(a, b)}
    assert got == {(i, j) for i in range(400) for j in range(400) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}


def plain(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_decontamination_equals_brute_force(spark, documents, clashing, empty):
    r = random.Random(3)
    item = prose(r, 25).split(" ")
    docs = spark.createDataFrame([(100, "start " + " ".join(item[4:15]) + " end"), (101, " ".join(item[:9])), (102, "Short, ITEM!"), (103, " ".join(item) * 2), (104, "tie " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "short item"), (3, None), (4, ""), (10, "solo"), (10, "tie " * 12), (None, "of the")], "item_id long, text string")
    wins = [(i.item_id, p[k : k + min(len(p), 10)]) for i in items.collect() if (p := plain(i.text)) for k in range(len(p) - min(len(p), 10) + 1)]
    for df in (docs, documents, clashing):
        for r_ in decontaminate.decontaminate(df, items).collect():
            ws, hit, ids = plain(r_.text), set(), set()
            for item_id, w in wins:
                for k in range(len(ws) - len(w) + 1):
                    if ws[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        ids |= {str(item_id)} - {"None"}
            sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            assert (r_.n_words, r_.n_hit, r_.n_items, r_.items_sha256, r_.contaminated) == (len(ws), len(hit), len(ids), sha, bool(hit))
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_quality_measures_equal_brute_force(documents, clashing, empty):
    def brute(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        many = {w for w in set(wins) if wins.count(w) > 1} if len(wins) < 3000 else set()
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = {i + k for i, w in enumerate(wins) if w in many for k in range(8)}
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    for df in (documents, clashing):
        led = quality.ledger(df)
        for r in quality.apply_policy(led).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text or "")
            assert r.kept == (r.fail_bits & quality.mask("v1") == 0)
    ab = {r.rule: r for r in quality.ablation(led).collect()}
    assert ab["few_words"].n_fail == led.filter("n_words < 20").count()
    assert ab["few_words"].n_kept == led.filter("fail_bits = 0").count()
    assert quality.ledger(empty).count() == 0


def test_let_computes_once(spark):
    df = spark.createDataFrame([([3, 1, 2],)], "a array<int>")
    assert df.select(let(F.array_sort("a"), lambda x: F.transform(x, lambda v, i: v * 10 + F.get(x, i))).alias("o")).first().o == [11, 22, 33]


def test_surrogates_keep_type_coreference_and_distinctness(spark, documents, clashing, empty):
    rows = [(1, "mail bob.x@a.co.uk, Bob.X@a.co.uk from 1.2.3.4, 11.2.3.45"), (2, "call +1 (386) 555-3733 or +1-386-555-3733, bob.x@a.co.uk"), (3, "cards 4041894974608795 4041-8949-7460-8795 and 4041894974608796"), (4, "Frau Müller and г-н Иванов"), (5, "version 4.0. in 2024 nothing else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymise(df.repartition(3), "k").collect()}
    assert {d: r.text for d, r in got.items()} == again
    assert {d: r.text for d, r in got.items()} != {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    a, b = re.findall(r"\S+@[\w.]+", got[1].text)
    assert a != "bob.x@a.co.uk" and a.lower() == b.lower() and a in got[2].text
    phones = re.findall(r"\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}", got[2].text)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "386" not in phones[0]
    x, y, z = re.findall(r"[\d-]{16,}", got[3].text)
    assert x == y.replace("-", "") != "4041894974608795" and z == "4041894974608796"
    digits = [int(c) for c in x][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"Frau [A-Z][a-z]+ and г-н [А-Я][а-я]+", got[4].text) and got[5].text == rows[4][1]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ip "), F.concat_ws(".", F.lit("9"), F.lit("8"), (F.col("id") / 250).cast("int"), F.col("id") % 250)).alias("text"))
    assert pii.pseudonymise(many, "k").select("text").distinct().count() == 3000
    for x in (documents, clashing):
        assert pii.pseudonymise(x, "k").count() == x.count()
    assert pii.pseudonymise(empty, "k").count() == 0


def test_secrets_and_names_of_many_kinds(spark):
    rows = ["password=4111111111111112 end", "4111111111111112 end", "Call Wei Zhang or Priya Patel", "Dr Olivia Smith wrote to Prof. Xu", "my name is Zorblat Quux.", "Call The Office", "+49 170 1234567 and +491701234567"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert re.fullmatch(r"password=\d{16} end", got[0].text) and "4111111111111112" not in got[0].text and got[0].n_entities == 1
    assert got[1].text == rows[1] and got[1].n_entities == 0
    for i, names in ((2, ("Zhang", "Patel")), (3, ("Smith", "Xu")), (4, ("Zorblat", "Quux"))):
        assert not any(n in got[i].text for n in names)
    a, b = got[6].text.split(" and ")
    assert a.replace(" ", "") == b and a.startswith("+49 ") and a != "+49 170 1234567"


def test_surrogates_equal_brute_force(spark, sf_dir):
    """Entities found by another engine of regular expressions; each gets one surrogate of its shape, all distinct."""
    import regex

    pattern = regex.compile(pii.PATTERN.replace("++", "+").replace(",}+", ",}"))
    luhn = lambda v: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(re.sub(r"\D", "", v)))) % 10 == 0
    card = regex.compile(f"(?:{pii.PATTERNS['card']})")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    digit = lambda v: re.sub(r"\d", r"\\d", re.escape(v))

    def shape(v):
        if "@" in v:
            return r"[^\s@]+@mail\d{5}\.example\.(?:com|net|org)"
        if re.fullmatch(r"[\d.]+", v) and v.count(".") == 3:
            return r"2\d\d\.\d+\.\d+\.\d+"
        if re.fullmatch(r"[^\W\d]+(?:[ '’-][^\W\d]+)*", v):
            return r"[^\W\d_]+(?: [^\W\d_]+)?"
        return re.sub("[a-z]", "[a-z]", re.sub("[A-Z]", "[A-Z]", digit(v).replace(r"\d", "0"))).replace("0", r"\d")

    of, total = {}, 0
    for r in docs.collect():
        at, made, found = 0, "", []
        for m in pattern.finditer(r.text or ""):
            if not card.fullmatch(m[0]) or luhn(m[0]):
                made += re.escape(r.text[at : m.start()]) + f"({shape(m[0])})"
                at = m.end()
                found.append(m[0])
        new = re.fullmatch(made + re.escape((r.text or "")[at:]), got[r.doc_id].text or "", re.S)
        assert new, (r.text, got[r.doc_id].text)
        for v, s in zip(found, new.groups(), strict=True):
            assert of.setdefault(v, s) == s != v
        total += len(found)
    assert total and total == sum(r.n_entities for r in got.values())
    assert len(set(of.values())) == len(of) and not set(of.values()) & set(of)


def test_secrets_of_marks_and_of_one_letter_end_with_distinct_surrogates(spark):
    """A blank to fill in is no secret; values with few letters or digits outnumber surrogates of their shape."""
    few = [f"{'-' * i}{c}{'_' * (8 - i)}" for i in range(9) for c in "0123456789abAB"]
    texts = ["Login form. password: ________ please", "token = --------", *(f"password: {v} ok" for v in few), *(f"secret: {i:08d}" for i in range(4000)), *(f"id 123-45-{i:04d}." for i in range(4000))]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[:2] == texts[:2] and len(set(got)) == len(texts)
    assert not {x.split(": ")[-1].split(" ")[0] for x in got[2 : 2 + len(few)]} & set(few)
    assert all(len(a) == len(b) for a, b in zip(got[-8000:], texts[-8000:]))


def test_colliding_surrogates_are_derived_anew(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda t, v, c, g, nonce, key: F.when(nonce == 0, F.lit("same")).otherwise(real(t, v, c, g, nonce, key)))
    df = spark.createDataFrame([(1, "a@b.com c@d.com e@f.com")], "doc_id long, text string")
    text = pii.pseudonymise(df, "k").first().text
    assert len(set(text.split(" "))) == 3 and text.split(" ").count("same") == 1


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    bad = ["idiot", "loser", "moron", "trash"]
    rows, labels = [], []
    for i in range(900):
        ws = prose(r, r.randrange(20, 120)).split(" ")
        toxic = i % 5 == 0
        for _ in range(len(ws) // 12 if toxic else 0):
            ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.held_out("doc_id")).join(labels, "doc_id").filter("held").collect()
    right = [(r.score >= 0.3) == (r.toxic == 1) for r in out]
    assert len(out) > 150 and sum(right) / len(right) > 0.9


def test_toxicity_of_odd_rows(spark, labelled, documents, clashing, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    for df in (documents, clashing):
        got = toxicity.score(df, model).select("score").collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert {r.score for r in toxicity.score(documents, none).select("score").collect()} == {0.0}


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline as p

    docs, labels = labelled
    r = random.Random(4)
    clean = prose(r, 300)
    item = prose(r, 12)
    extra = [(5000, clean), (5001, clean), (5002, f"mail me.now@there.org {prose(r, 50)}"), (5003, f"{prose(r, 40)} {item} {prose(r, 9)}"), (5004, None)]
    full = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [f.__name__ for _, f in p.STAGES] == ["drop_toxic", "drop_near_duplicates", "drop_contaminated", "hide_personal_data", "encode"]
    stage = dict(p.STAGES)
    left = stage["toxicity"](spark, full, str(tmp_path))
    assert left.columns == full.columns
    kept = {x.doc_id for x in left.collect()}
    toxic = {x.doc_id for x in labels.filter("toxic = 1").collect()}
    assert len(kept & toxic) < 0.2 * len(toxic) and len(kept - toxic) > 0.95 * 725 and {5000, 5001, 5002, 5004} <= kept
    one = {x.doc_id for x in stage["near_duplicates"](spark, full, str(tmp_path)).collect()}
    assert 5000 in one and 5001 not in one
    assert {5003} == set(range(5000, 5005)) - {x.doc_id for x in stage["decontamination"](spark, full, str(tmp_path)).collect()}
    hidden = stage["pii"](spark, full, str(tmp_path))
    assert hidden.columns == full.columns and hidden.filter("text like '%me.now@there.org%'").count() == 0
    out = p.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} >= {5000, 5002, 5004} and not {x.doc_id for x in out} & {5001, 5003}
    assert all(x.n_tokens == len(x.token_ids) for x in out)


def test_similar_documents_follow_jaccard(spark, documents, clashing, empty):
    r = random.Random(8)
    rows, group = [], {}
    for g in range(60):
        base = prose(r, 200).split(" ")
        for c in range(3):
            ws = list(base)
            for _ in range(2 * c):
                ws[r.randrange(len(ws))] = prose(r, 1) + "q"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(ws)))

    def jaccard(a, b):
        x, y = ({tuple(t.split(" ")[i : i + 5]) for i in range(len(t.split(" ")) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j] and jaccard(rows[i][1], rows[j][1]) >= 0.82]
    assert len(alike) > 50 and sum(got[i] == got[j] for i, j in alike) / len(alike) > 0.9
    assert all(group[i] == group[c] for i, c in got.items())
    for df in (documents, clashing):
        out = {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()}
        assert len(out) == df.select("doc_id").distinct().count() and out[4] == out[6] == out[7] and out[9] == out[10] == out[11]
    assert simhash.similar_documents(empty).count() == 0


def test_similar_documents_are_verified_exactly(spark):
    """Pairs of word sets with chosen Jaccard similarities: those below 0.8 stay apart, nearly all at 0.8 are linked."""
    rows, want = [], []
    for i in range(400):
        swapped = (11, 12, 16, 20)[i % 4]  # of 100: Jaccard 0.802, 0.786, 0.724, 0.667
        ws = [f"w{i}x{j}" for j in range(100)]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws[swapped:] + [f"v{i}x{j}" for j in range(swapped)]))]
        want.append(swapped == 11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df, 0.8, 1).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(400)]
    assert not any(x for x, w in zip(linked, want) if not w)
    assert sum(x for x, w in zip(linked, want) if w) >= 97


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_verified_links_in_tiles_lose_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "SHINGLES", size)
    r = random.Random(4)
    rows, sets = [], {}
    for i in range(60):
        base = [f"a{i % 3}x{j}" for j in range(60)]
        for _ in range(r.randrange(9)):
            base[r.randrange(60)] = f"b{i}x{r.randrange(99)}"
        sets[i] = set(base)
        rows.append((i, " ".join(base)))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 1).collect()}
    least = dict.fromkeys(sets)
    for i in sets:
        todo = [i] if least[i] is None else []
        while todo:
            least[at := todo.pop()] = i
            todo += [j for j in sets if least[j] is None and len(sets[at] & sets[j]) >= 0.8 * len(sets[at] | sets[j])]
    assert got == least


@pytest.mark.parametrize("most", [0, 16_384])
def test_pick_rows_by_bitmaps_and_by_join(spark, tmp_path, monkeypatch, most):
    from spindrift.llm import common

    monkeypatch.setattr(common, "BITMAPS", most)
    df = common.write_table(spark.range(0, 3000, 1, 7).withColumn("row", F.monotonically_increasing_id()), "numbered")
    chosen = common.write_table(df.filter("id % 97 = 0 OR id IN (1, 2999)").select("row"), "chosen")
    assert sorted(x.id for x in common.pick_rows(df, "row", chosen).collect()) == sorted({*range(0, 3000, 97), 1, 2999})
    assert common.pick_rows(df, "row", chosen.limit(0)).count() == 0


def test_near_duplicate_stage_with_null_ids(spark):
    import corpus_pipeline as p

    r = random.Random(11)
    own, other, known = (prose(r, 80).split(" ") for _ in range(3))
    text = {"own": " ".join(own), "other": " ".join(other), "known": " ".join(known), "near": " ".join([*known[:-1], "changed"]), "free": prose(r, 80)}

    def left(*rows):
        got = p.drop_near_duplicates(spark, spark.createDataFrame([(i, text[t], "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "")
        return sorted(((x.doc_id, next(k for k, v in text.items() if v == x.text)) for x in got.collect()), key=repr)

    assert left((5, "known"), (None, "own")) == [(5, "known"), (None, "own")]
    assert left((5, "known"), (None, "own"), (None, "other"), (None, "near"), (None, "own"), (7, "free"), (7, "free")) == [(5, "known"), (7, "free"), (None, "other"), (None, "own")]


def test_more_names_than_surnames_of_four_syllables(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {s: x[:2] for s, x in pii.SYLLABLES.items()})
    letters = "abcdefgh"
    names = [f"Q{a}{b}{c}" for a in letters for b in letters for c in letters[:4]]
    df = spark.createDataFrame([(i, f"Yesterday Mr {n} left.") for i, n in enumerate(names)], "doc_id long, text string")
    got = [x.text for x in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == len(names) == 256 and not any(n in t for n in names for t in got)
    assert all(re.fullmatch(r"Yesterday Mr [A-Z][a-z]+ left\.", t) for t in got)


def test_pipeline_stages_bear_odd_rows(spark, labelled, documents, clashing, empty, tmp_path):
    import corpus_pipeline as p

    labelled[1].limit(40).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage stands in any of these texts at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        got = stage(spark, clashing, str(tmp_path))
        assert got.count() > 0, name
        if name != "token_ids":
            assert got.schema.simpleString() == clashing.schema.simpleString(), name
            assert name == "pii" or got.exceptAll(clashing).count() == 0, name
    kept = p.drop_near_duplicates(spark, documents, str(tmp_path)).collect()
    assert len({x.text for x in kept if x.doc_id is not None}) == len([x for x in kept if x.doc_id is not None])


@pytest.mark.parametrize("name", ["op7_quality_ledger", "op8_decontamination", "op10_warc"])
def test_registered_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    from spindrift.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_long_texts_do_not_empty_the_training_sample(spark):
    """A text over the byte bound is passed over, large ones come last, and what stands behind them by hash still counts."""
    rows = [(i, "x" * (5000 if i % 3 == 0 else 900 if i % 3 == 1 else 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for part in toxicity.sample(docs, labels, 100, 2000):
        sizes = [len(t) for t in part]
        assert max(sizes) <= 900 and sizes.count(40) >= 5 and sum(sizes) <= 2000 and sizes.count(900) == (2000 - 40 * sizes.count(40)) // 900


def test_features_equal_a_plain_reading():
    """Windows, compressed lengths and their summary, written again without arrays."""
    import zstandard as z

    model = toxicity.train(["you vile rotten pest go away now friend " * 3 + str(i) for i in range(40)], ["the weather is mild and the garden grows well " * 3 + str(i) for i in range(40)])
    text = "What a vile rotten day, the garden grows well and the pest of a weather goes on and on without any end in sight " * 2
    raw, pieces = text.lower().encode(), []
    while raw:
        cut = raw[:64]
        if len(raw) > 64:
            at = cut.rfind(b" ", 1)
            cut = cut[:at] if at > 0 else cut
        pieces.append(cut)
        raw = raw[len(cut) :]
    size = lambda d, w: len(z.ZstdCompressor(level=toxicity.LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))
    gaps = sorted(size(model.ordinary, w) - size(model.toxic, w) for w in pieces)
    mean = sum(gaps) / len(gaps)
    want = [1, max(-4, min(4, mean)), max(-8, min(16, sum(gaps[-2:]) / 2)) / 4, *(2 * (sum(g >= k for g in gaps) / len(gaps)) ** 0.5 for k in toxicity.THRESHOLDS)]
    assert len(pieces) == len(toxicity.windows(text)) and max(abs(a - b) for a, b in zip(model.features([text])[0], want)) < 1e-9
