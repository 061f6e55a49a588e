"""The field on forms of secrets, and of what only looks like them, that are not in its training."""

import numpy as np

from rivulet.llm import secrets
from rivulet.llm.common import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER, DIGITS = UPPER.lower(), "0123456789"
ALL, HEX = UPPER + LOWER + DIGITS, DIGITS + "abcdef"


def forms(rng):
    draw = lambda among, n: "".join(among[k] for k in rng.integers(0, len(among), n))
    held = {
        "slack": lambda: ("", f"xoxb-{draw(DIGITS, 12)}-{draw(ALL, 24)}"),
        "stripe": lambda: ("", "sk_live_" + draw(ALL, 24)),
        "npm": lambda: ("", "npm_" + draw(ALL, 36)),
        "google": lambda: ("", "AIza" + draw(ALL + "_-", 35)),
        "sendgrid": lambda: ("", f"SG.{draw(ALL, 22)}.{draw(ALL + '_-', 43)}"),
        "pem": lambda: ("-----BEGIN PRIVATE KEY-----\n", draw(ALL + "+/", 64)),
        "in an address": lambda: ("postgres://admin:", draw(ALL, 12) + "@db.example.com/x"),
        "account": lambda: ("AccountName=foo;AccountKey=", draw(ALL + "+/", 86) + "=="),
        "basic": lambda: ("Authorization: Basic ", draw(UPPER + LOWER, 24)),
        "bearer of letters": lambda: ("Authorization: Bearer ", draw(UPPER + LOWER, 40)),
        "bearer": lambda: ("Authorization: Bearer ", ".".join(draw(ALL, n) for n in (30, 60, 43))),
        "letters": lambda: ("pwd: ", draw(LOWER, 10)),
        "word and digits": lambda: ("db_pwd=", draw(LOWER, 6) + draw(DIGITS, 4)),
        "aws": lambda: ("aws_secret_access_key = ", draw(ALL + "+/", 40)),
        "private": lambda: ("private_key=", draw(ALL, 32)),
    }
    others = {
        "image": lambda: ('<img src="data:image/png;base64,', draw(ALL + "+/", 200)),
        "commit": lambda: ("commit ", draw(HEX, 12)),
        "parcel": lambda: ("parcel number ", "1Z" + draw(UPPER + DIGITS, 16)),
        "video": lambda: ("https://www.youtube.com/watch?v=", draw(ALL + "_-", 11)),
        "address": lambda: ("https://docs.example.com/d/", draw(ALL, 24) + "/edit"),
        "colour": lambda: ("color: #", draw(HEX, 6)),
        "sku": lambda: ("SKU ", f"{draw(UPPER, 2)}-{draw(DIGITS, 5)}-{draw(UPPER, 2)}"),
        "uuid": lambda: ("", "-".join(draw(HEX, n) for n in (8, 4, 4, 4, 12))),
        "doi": lambda: ("doi 10.1038/", "s41586-020-" + draw(DIGITS, 5)),
        "path": lambda: ("/usr/local/lib/", f"python3.{draw(DIGITS, 2)}/site-packages/{draw(LOWER, 8)}"),
        "order": lambda: ("order number ", draw(DIGITS, 10)),
        "isbn": lambda: ("ISBN ", f"978-3-{draw(DIGITS, 6)}-{draw(DIGITS, 2)}"),
        "words": lambda: ("a key ", "question of interest"),
    }
    return held, others


def test_forms_that_are_not_learnt(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    field = secrets.fit(docs)
    texts = sorted(r.text for r in docs.where("length(text) BETWEEN 300 AND 5000").collect())
    rng = np.random.default_rng(3)
    held, others = forms(rng)

    def rate(kinds, judged, n=20):
        hits = 0
        for made in kinds.values():
            for _ in range(n):
                words = texts[rng.integers(len(texts))].split(" ")
                at = int(rng.integers(len(words)))
                lead, value = made()
                left = " ".join([*words[:at], ""]) + lead
                found = secrets.scan(left + value + " " + " ".join(words[at:]), field)
                hits += judged(found, len(left), len(left) + len(value))
        return hits / (n * len(kinds))

    whole = lambda found, a, b: any(s <= a and e >= b - 14 for s, _, e in found)
    assert rate(held, whole) >= 0.9
    assert rate(others, lambda found, a, b: any(k == 3 and s < b and e > a - 60 for s, k, e in found)) <= 0.05
    assert not [r.doc_id for r in docs.collect() if any(k == 3 for _, k, _ in secrets.scan(r.text or "", field))]


def test_places_without_digits():
    text = 'Authorization: Basic QWxhZGRpbjpvcGVu and pwd: abcdefghij, "key": "LettersOnlyHere" but a key question of interest'
    found = {text[a:b] for a, b in secrets._places(text)}
    assert {"QWxhZGRpbjpvcGVu", "abcdefghij", "LettersOnlyHere"} <= found and "question" not in found
