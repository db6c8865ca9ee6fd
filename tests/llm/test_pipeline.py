"""The pipeline's stages after language ID against a brute-force version."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import corpus_pipeline
import regex
from test_operators import WORD

from plumbline.llm import language_id, simhash


def _lines(docs):
    sites, first = defaultdict(set), {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        for k, line in enumerate((d["text"] or "").split("\n")):
            if t := line.strip(" "):
                sites[t].add(d["source"] or "")
                first.setdefault(t, (d["doc_id"], k))
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not (len(sites[x.strip(" ")]) >= 10 and first[x.strip(" ")] != (d["doc_id"], k))]
        if len(kept) == len(lines):
            out.append(d)
        elif (text := "\n".join(kept)).strip(" "):
            out.append({**d, "text": text, "n_chars": len(text)})
    return out


def _shingles(text):
    words = [w for w in regex.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    n = min(5, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def near_groups(docs):
    """Least id reachable over pairs with 0.8 or more of five-word shingles in common; docs: list of (id, text)."""
    sets = [(i, _shingles(t or "")) for i, t in docs]
    label = {i: i for i, _ in sets}
    links = [(i, j) for (i, x), (j, y) in itertools.combinations(sets, 2) if x == y or len(x & y) >= 0.8 * len(x | y) > 0]
    while changed := [(i, j) for i, j in links if label[i] != label[j]]:
        for i, j in changed:
            label[i] = label[j] = min(label[i], label[j])
    return label


def _near(docs):
    label = near_groups([(d["doc_id"], d["text"]) for d in docs])
    return [d for d in docs if label[d["doc_id"]] == d["doc_id"]]


def _words(text):
    return WORD.findall(regex.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def _clean(docs, items):
    windows = defaultdict(set)
    for words in map(_words, items):
        n = min(10, len(words))
        if n:
            windows[n] |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    hit = lambda w: any(tuple(w[i : i + n]) in s for n, s in windows.items() for i in range(len(w) - n + 1))
    return [d for d in docs if not hit(_words(d["text"]))]


def _mixed(docs):
    n = defaultdict(int)
    for d in docs:
        n[d["source"] or ""] += 1
    total = sum(math.sqrt(x) for x in n.values())
    out = []
    for d in docs:
        m = n[d["source"] or ""]
        rate = math.sqrt(m) / total * len(docs) / m
        u = int(hashlib.md5(f"20240601:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        while (below := p) <= u:
            k, p = k + 1, below + math.exp(-rate + (k + 1) * math.log(rate) - math.lgamma(k + 2))
        out += [(d["doc_id"], c, d["text"]) for c in range(1, k + 1)]
    return out


def test_pipeline_brute_force(spark, sf_dir):
    tables = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, tables, sf_dir)
    assert kept.columns == tables.columns and kept.count() >= 0.9 * tables.count()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = _mixed(_clean(_near(_lines([r.asDict() for r in kept.collect()])), items))
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.copy_no, r.text) for r in got.collect()) == sorted(docs)


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "mix_sources"]
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


NAMES = "doc_id long, text string, lang string, source string, n_chars long, rest string, _pl_lang string, copy_no int, `a.b` int"


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns: what each stage keeps."""
    words = [f"word{k}" for k in range(40)]
    text, close, long = " ".join(words), " ".join([*words[:39], "other"]), "river and stone " * 30_000
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, close, "en", None), (3, None, None, None), (4, "", "en", "a"), (5, long, "en", "a"), (None, text, "en", "a"), (7, "12 34", None, "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "r", "x", 9, 1) for r in rows], NAMES)
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: sorted(stages[name](spark, docs, sf_dir).collect(), key=lambda r: (r.doc_id is None, r.doc_id)) for name in list(stages)[:4]}
    for name, got in kept.items():
        assert got[0].__fields__ == docs.columns and all((r.rest, r._pl_lang, r.copy_no, r["a.b"]) == ("r", "x", 9, 1) for r in got), name
    ids = {name: [r.doc_id for r in got] for name, got in kept.items()}
    assert ids["language_id"] == [1, 1, 2, 5, None]
    assert ids["line_dedup"] == ids["decontaminate"] == [1, 1, 2, 3, 4, 5, 7, None]
    assert ids["simhash_dedup"] == [1, 3, 5, 7, None]
    assert [r.text for r in kept["line_dedup"]] == [text, text, close, None, "", long, "12 34", text]
    mixed = stages["mix_sources"](spark, docs, sf_dir)
    assert mixed.columns == [*[c for c in docs.columns if c != "copy_no"], "copy_no", "shuffle_key"]
    n = mixed.groupBy("doc_id").count().collect()
    assert all(r["count"] % 2 == 0 for r in n if r.doc_id == 1)  # repeated rows are drawn alike


def test_similar_documents(spark):
    """Near copies of many texts by exact Jaccard; groups from two to many, and texts just too far apart."""
    rng = random.Random(8)
    docs = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for copy in range(rng.choice([1, 2, 3, 30])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 45)) if copy else 0):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", "one two", "one two", "one three", "\t"])]
    wanted = near_groups(docs)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    apart = sum(got[i] != wanted[i] for i in wanted)
    assert apart <= 0.02 * len(docs) and all(wanted[i] == wanted[got[i]] for i in got)


def _changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(3, len(words), 6), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def test_similar_documents_in_large_buckets(spark, monkeypatch):
    """Buckets whose least and one hub meet few of their members give the links that a join of all their members gives: texts just too far apart, each with a twin."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(600)]
    docs = []
    for _ in range(150):
        words = _changed(rng, base, 6)
        docs += [(2 * len(docs) + k, " ".join(_changed(rng, words, 5))) for k in range(2)]
    monkeypatch.setattr(simhash, "HUBS", 1)
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 5)
    found = []
    for small in (10**6, 2):
        monkeypatch.setattr(simhash, "SMALL", small)
        got = simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"))
        found.append({r.doc_id: r.component_id for r in got.collect()})
    assert len(set(found[0].values())) < 200 and found[1] == found[0]


def test_large_buckets_block_by_block(spark, monkeypatch):
    """Pairs of other labels and near fingerprints that share a large bucket, against all pairs; buckets of one label or few members give none."""
    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = list({signed(rng.choice(centre) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 14)))) for _ in range(150)})
    label = {f: rng.choice([1, 1, 1, 2, f]) for f in prints}
    rows = [(key, f, label[f]) for key in range(-3, 5) for f in rng.sample(prints, [3, 40, 90, 150][key % 4])] + [(9, f, label[f]) for f in prints if label[f] == 1]
    wanted = set()
    for key in {k for k, _, _ in rows}:
        of = [f for k, f, _ in rows if k == key]
        if len(of) > 10:
            wanted |= {(min(x, y), max(x, y)) for x, y in itertools.combinations(of, 2) if label[x] != label[y] and ((x ^ y) & (1 << 64) - 1).bit_count() <= simhash.CHECK_RADIUS}
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 16)
    got = [tuple(r) for r in simhash._met_in_large(spark.createDataFrame(rows, "key int, fp long, label long"), 10).collect()]
    assert set(got) == wanted and len(got) == len(wanted)  # each from one of its buckets


def test_every_document_is_labelled_once(spark, sf_dir, monkeypatch):
    """Language labelling isn't repeated for the jobs of the stages behind it."""
    seen = spark.sparkContext.accumulator(0)
    plain = language_id.label

    def counted(docs, model):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(docs.mapInArrow(run, docs.schema), model)

    monkeypatch.setattr(language_id, "label", counted)
    corpus_pipeline.run(spark, sf_dir).count()
    assert seen.value == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
