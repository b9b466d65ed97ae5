from itertools import permutations

import pytest

from exposurelab.llm import filter_audit as fa

from .helpers import no_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int"
ROWS = "part string, mask int, n long, good long, toxic long"


def slowly(docs, labels):
    """Every order applied filter by filter to lists of documents."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    items = []
    for key, text, lang in docs:
        text = text or ""
        words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs),
        }
        items.append((lang or "", key, {f for f, bad in fails.items() if bad}))
    made = {}
    for part in {p for p, _, _ in items}:
        mine = [(k, f) for p, k, f in items if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out = [(k, bad) for k, bad in left if f in bad]
                left = [(k, bad) for k, bad in left if f not in bad]
                sums[f] += len(out)
                made[part, "".join(order), step] = [
                    len(left), len(out), sum(f in bad for _, bad in mine) - len(out), sum(bad == {f} for _, bad in mine),
                    sum(k in good for k, _ in out), sum(k in toxic for k, _ in out),
                ]
        for (p, order, step), row in made.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return made


def checked(spark, docs, labels, rows):
    found = fa.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    expected = slowly(rows, labels)
    made = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}
    assert len(found) == len(made) and made == expected


LABELLED = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_odd_documents_against_walking_through(spark):
    docs = odd_docs(spark)
    checked(spark, docs, LABELLED, [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()])


def test_copies_across_parts(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i, text, ["en", "de", None, ""][i % 4]) for i in range(40)]
    rows += [(100 + i, f"{text} x{i % 3} #", "en") for i in range(7)] + [(200, "ABC DEF", "de"), (0, text, "en"), (None, text, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    checked(spark, docs, LABELLED, rows)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert fa.audit(no_docs(spark), labels).count() == 0
    rows = fa.audit(odd_docs(spark), labels).collect()
    assert len(rows) == 120 * 5 * 3 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_potential_gives_shapley_values(spark):
    """Two filters: 3 documents fail both, 5 only the first, 1 only the second."""
    counts = spark.createDataFrame([("p", 3, 3, 1, 0), ("p", 1, 5, 0, 2), ("p", 2, 1, 0, 0), ("p", 0, 4, 4, 0)], ROWS)
    rows = {(r["filter_order"], r["step"]): r for r in fa.interactions(counts, "xy").collect()}
    assert rows["xy", 1]["shapley"] == 2 * 6.5 and rows["xy", 2]["shapley"] == 2 * 2.5
    assert (rows["yx", 2]["removed"], rows["yx", 2]["redundant"], rows["yx", 2]["kept"]) == (5, 3, 4)
    with pytest.raises(ValueError):
        fa.interactions(counts, "")
    with pytest.raises(ValueError):
        fa.interactions(counts, "aa")


def test_one_filter_and_other_losses(spark):
    counts = spark.createDataFrame([("p", 1, 3, 2)], "part string, mask int, n long, cost long")
    row = fa.interactions(counts, "z", ["cost"]).first()
    assert (row["kept"], row["removed"], row["cost_lost"], row["shapley"]) == (0, 3, 2, 3)
