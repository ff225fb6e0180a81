"""Which values of secret scans count as widely copied, by repositories and owners."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest

from quarry.llm import secrets
from tests.llm.test_operators import by_id, real, table


def test_a_value_in_many_documents_of_one_owner_is_widely_copied(spark):
    many, few, repeated = "aB3dE5gH7jK9mN1pQ3sT5", "cB3dE5gH7jK9mN1pQ3sT5", "eB3dE5gH7jK9mN1pQ3sT5"
    texts = [f"zz {many} zz"] * secrets.MANY + [f"zz {few} {many}", f"zz {few}"] + [f"zz {repeated}"] * secrets.MANY
    ids = [*range(secrets.MANY + 2), *[99] * secrets.MANY]
    got = by_id(secrets.secrets(table(spark, texts, ids)))  # one owner
    assert (got[0].spans, got[0].n_owner_specific, got[0].n_widely_copied) == ("", 0, 1)
    assert (got[0].repositories, got[0].owners) == (str(secrets.MANY + 1), "1")
    both = got[secrets.MANY]
    assert (both.spans, both.n_owner_specific, both.n_widely_copied) == ("owned:3:24", 1, 1)
    assert (both.repositories, both.owners) == (f"2,{secrets.MANY + 1}", "1,1")
    assert (got[99].spans, got[99].repositories) == ("owned:3:24", "1")


def test_rows_without_doc_id_are_documents_of_their_own(spark):
    value = "aB3dE5gH7jK9mN1pQ3sT5"
    rows = secrets.secrets(table(spark, [f"zz {value}"] * secrets.MANY, [None] * secrets.MANY)).collect()
    assert {(x.spans, x.repositories) for x in rows} == {("", str(secrets.MANY))}


def candidates_by_brute_force(text):
    """(start, kind, end, value), each kind by its own search over the whole text."""
    text = text or ""
    out = [(m.start(), "assign", m.end(), m[2]) for m in re.finditer(secrets.ASSIGN, text, re.A | re.I) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = list(out)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        v, share = m[0], [n / len(m[0]) for n in Counter(m[0]).values()]
        uneven = any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and -sum(p * math.log2(p) for p in share) >= 3.5
        if uneven and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), "owned", m.end(), v))
    order = ["assign", "access", "hex", "owned"]
    return sorted(out, key=lambda x: (x[0], order.index(x[1])))


@pytest.mark.parametrize("hot", [1, 50, 10**9])
def test_ownership_by_brute_force_over_documents(spark, monkeypatch, hot):
    """The documents of the table with keys planted: owner-specific ones, ones of several owners, a template's of one owner."""
    monkeypatch.setattr(secrets, "HOT", hot)
    r = random.Random(4)
    key = lambda: "x9" + "".join(r.choices(string.ascii_letters + string.digits, k=26)) + "Q"
    rows = [[x.doc_id, x.text or "", x.source] for x in real(spark).orderBy("doc_id").collect()]
    own, shared, template = [key() for _ in range(12)], [key() for _ in range(5)], key()
    for k in own:
        r.choice(rows)[1] += f" see {k} now"
    for k in shared:
        for row in r.sample(rows, 8):
            row[1] = f"{k} {row[1]}"
    first = [row for row in rows if row[2] == rows[0][2]]
    for row in first[: secrets.MANY + 2]:
        row[1] += f" key {template}."
    docs = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, source string")
    found = {i: candidates_by_brute_force(t) for i, t, _ in rows}
    places, owners = defaultdict(set), defaultdict(set)
    for i, _, source in rows:
        for *_, v in found[i]:
            places[v].add(i)
            owners[v].add(source)
    live = lambda v: len(owners[v]) == 1 and len(places[v]) < secrets.MANY
    got = by_id(secrets.secrets(docs))
    added = 0
    for i, _, _ in rows:
        want = [f"{k}:{a}:{b}" for a, k, b, v in found[i] if k != "owned" or live(v)]
        added += sum(k == "owned" and live(v) for _, k, _, v in found[i])
        assert got[i].spans == ",".join(want), i
        assert got[i].repositories == ",".join(str(len(places[v])) for *_, v in found[i]) and got[i].owners == ",".join(str(len(owners[v])) for *_, v in found[i])
        assert (got[i].n_owner_specific, got[i].n_widely_copied) == (sum(live(v) for *_, v in found[i]), sum(not live(v) for *_, v in found[i]))
    assert added >= len(own) and template in places and len(places[template]) >= secrets.MANY and not live(template)
