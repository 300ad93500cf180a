import hashlib
import math
import random
import re

from pyspark.sql import Row

from passagecraft.llm import pii
from passagecraft.llm.common import Tables

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            double = sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) + sum(d[-1::-2])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and double % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rnd = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "x@y.zz", "1", "255", "256", "10.0.0.1", " ", "+", "+1 (509) 555-6973", "4532015112830366", "4532 0151 1283 0366", "é", "\n", "001", "%", "1.2.3.4.5"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), t
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000)  # no quadratic look


def test_report_and_terms(spark):
    texts = [f"filler{i} words that differ{i} here: Zorblax wrote from bob@corp.example.com about topic{chr(97 + i) * 3} then{chr(97 + i) * 3}" for i in range(6)]
    texts += ["Zorblax was seen today", None, "", "nothing personal inside", "nothing personal inside"] + [f"other text number {i} with other words" for i in range(900)]
    texts += ["one passage with Quuxly and ann@corp.example.com in it and then some more words follow"] * 5 + [f"one passage with Quuxly and ann@corp.example.com in it and then some more words follow. Tail{i}" for i in range(5)]
    df = spark.createDataFrame([Row(doc_id=i if i else None, text=t, key="clash", base=1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, spans = got[i if i else None], plain_spans(t or "")
        said = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in spans) for n in range(4))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    assert got[6].spans == "term:0:7"  # the name alone gives the address away
    assert "term" not in got[9].spans and "term" not in got[20].spans
    assert got[len(texts) - 1].n_terms == 0  # near copies are one witness
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "bob@" not in clean[1] and "<EMAIL>" in clean[1] and "Zorblax" not in clean[6] and clean[7] is None and clean[9] == texts[9]
    assert pii.sanitise(df).columns == df.columns
    assert pii.report(df.limit(0)).count() == 0


def told(rnd, n):
    """Words that no two texts share much of."""
    return " ".join("".join(rnd.choice("bcdfgmnprt") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)]).repartition(4)


def test_terms_of_whole_texts(spark):
    rnd = random.Random(8)
    texts = [f"Vexlor {told(rnd, 60)} from 10.1.2.3 and {told(rnd, 60)}" for _ in range(12)] + ["Vexlor was here"]  # over many texts, far from the address
    texts += [f"Glimt {told(rnd, 60)} write to eve@corp.example.com {told(rnd, 30)} again eve@corp.example.com please"]  # in one text alone
    texts += ["Glimt again"] + [f"Orvane {told(random.Random(1), 60)} call 192.168.7.9 now"] * 4  # copies
    near = told(rnd, 200).split()
    texts += [" ".join(["Ostrel", *near[:i * 20], f"changed{i}", *near[i * 20 :], "at ost@corp.example.com"]) for i in range(1, 6)]  # near copies
    texts += [f"{told(rnd, 30)} from and write again call now please" for _ in range(300)]
    terms = {r.term: r.removed for r in pii.disclosing(docs_of(spark, texts)).collect()}
    assert terms == {"vexlor": False}
    got = {r.doc_id: r for r in pii.report(docs_of(spark, texts)).collect()}
    assert got[12].spans == "term:0:6" and got[13].n_terms == got[14].n_terms == got[15].n_terms == got[20].n_terms == 0
    common = [f"Footer {told(rnd, 20)} mail help@corp.example.com now" for i in range(30)]
    assert pii.disclosing(docs_of(spark, common)).count() == 0  # in every text: tells nothing


def test_one_text_never_discloses(spark):
    rnd = random.Random(3)
    long = f"{told(rnd, 3000)} ".join(f"me{i % 7}@corp.example.com" for i in range(1000))
    texts = [long, *[" ".join(f"me{i}@corp.example.com {told(rnd, 6)}" for i in range(1000))] * 3] + [told(rnd, 40) for _ in range(50)]
    found = {r.doc_id: r for r in pii.report(docs_of(spark, texts)).collect()}
    assert all(r.n_terms == 0 for r in found.values()) and found[0].n_email == found[1].n_email == 1000


def test_lists_of_addresses_cost_one(spark):
    rnd = random.Random(4)
    listed = " ".join(f"me{i}@corp.example.com" for i in range(2000))
    texts = [f"Kervad {told(rnd, 2000)} {listed} {told(rnd, 2000)}" for _ in range(8)] + [told(rnd, 40) for _ in range(400)]
    tables = Tables()
    rows = pii.judged(docs_of(spark, texts), tables)
    assert rows.where("term = 'kervad'").count() == 1 and {r.term for r in pii.disclosing(docs_of(spark, texts)).collect()} >= {"kervad"}
    classes = next(p for _, p in tables.paths if "pii-classes" in p)
    assert spark.read.parquet(classes).count() == 8


def plain_g2(both, one, other, every):
    x = lambda n: n * math.log(n) if n > 0 else 0.0
    return 2 * (x(both) + x(one - both) + x(other - both) + x(every - one - other + both) - x(one) - x(every - one) - x(other) - x(every - other) + x(every))


def test_disclosure_against_a_plain_estimate(spark):
    rnd = random.Random(12)
    names = [f"Name{chr(97 + i)}x" for i in range(12)]
    texts = []
    for i in range(700):
        words = told(rnd, rnd.randint(12, 25)).split()
        if i % 3 == 0:
            k = rnd.randrange(12)
            words.insert(rnd.randrange(len(words)), names[k] if rnd.random() < 0.9 else rnd.choice(names))
            for _ in range(rnd.randrange(3)):  # an entity may stand in a text more than once
                if rnd.random() < 0.2 + 0.06 * k:
                    words.insert(rnd.randrange(len(words)), f"u{k}@corp.example.com")
        texts.append(" ".join(words) + ".")
    texts += [texts[3 * i] for i in range(20)] * 2
    terms_of = [set(re.findall(r"[a-z]{3,}", re.sub(r"\S+@\S+", " ", t.lower()))) for t in texts]
    looks = [pii.contexts_of(t) for t in texts]
    witnesses = lambda some, e: min(len({dict(looks[i][0])[e] for i in some}), *(len({looks[i][2][k] for i in some}) for k in range(pii.SHAPES)))
    want = {}
    for k in range(12):
        mail = f"email:u{k}@corp.example.com"
        having = [i for i in range(len(texts)) if mail in dict(looks[i][0])]
        for term in set().union(*(terms_of[i] for i in having)) if having else ():
            holding, every = [i for i in having if term in terms_of[i]], sum(term in x for x in terms_of)
            n = witnesses(holding, mail)
            if n < 2:
                continue
            share, own = len(holding) / every * n / (n + 1), math.log2(len(texts) / len(having))
            if share >= 0.5 and math.log2(share) + own >= 0.5 * own and plain_g2(n, witnesses(having, mail), n + every - len(holding), len(texts)) >= 24:
                want[term] = want.get(term, False) or share >= 0.9
    assert want and set(want) <= {n.lower() for n in names}
    assert {r.term: r.removed for r in pii.disclosing(docs_of(spark, texts)).collect()} == want
