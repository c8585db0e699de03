"""Personal data and secrets against plain regular expressions."""

import hashlib
import random
import re

import pytest

from leafgrade.llm import pii, secret_scan


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def plain_secrets(t):
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(pattern, t, re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["ab@.- +1", "0123 .-+()", "012 .", "4111 -", "a@b.c@-", "0123456789 -.+"])
def test_base_personal_data_equals_regexes(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert pii.scan(t)[0] == plain_pii(t), t


def test_base_secrets_equal_regexes():
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", '="', ": ", "'", "=", " ", "abc", "0af9" * 7, "AKIA", "AKIA" + "Z9" * 9, "\u017fecret", "to\u212aen=abcdefg"]
    for _ in range(6000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        assert secret_scan.scan(t, 8)[0] == plain_secrets(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "1." * 100_000, "+1 " * 50_000, "f" * 23 + " " + "0" * 200_000):
        assert pii.scan(t)[0] is not None and secret_scan.scan(t, 8) is not None


def test_personal_data_query(spark, docs_frame, odd_docs):
    texts = {10: "write to jo.doe@mail.example.com or jo (at) example (dot) org", 11: "call (415) 555-2671 or +1 (415) 555-2671", 12: "card 4111 1111 1111 1111 from 10.0.0.1",
             13: "version 1.2.300.4, order 4111111111111112, build 20240101", 14: "on 2024-01-02 some 123456789 things happened"}
    got = {r.doc_id: r for r in pii.find_personal_data(docs_frame(list(texts.items())), sample_docs=10).collect()}
    for k, t in texts.items():
        base = plain_pii(t)
        assert got[k].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(got[k].spans.split(","))
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == x for s in base) for x in pii.KINDS]
    assert "email:36:61" in got[10].spans and "phone:5:19" in got[11].spans
    assert got[13].spans == "" and got[14].spans == ""
    odd = pii.find_personal_data(odd_docs, sample_docs=3).collect()
    assert len(odd) == 10 and all(r.spans == "" for r in odd)
    assert pii.find_personal_data(odd_docs.limit(0)).collect() == []


def test_guess_cost_orders_passwords():
    cost = secret_scan.guess_cost
    assert cost("password") < cost("monkey2019") < cost("qwerty123") < cost("hunter2") < cost("xK9$mQ2vLp7!")
    assert cost("aaaaaaaaaaaa") < 4 and cost("") == 0 and cost("required") < 3


def test_secrets_query_and_redaction(spark, docs_frame, odd_docs):
    texts = {20: "pwd: xK9$mQ2vLp7! and pwd: changeme", 21: "password=b7db7aa4a5fcc78305 here", 22: "see ftp://me:Zq8!rT5#wq@host/x", 23: "login is required"}
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs_frame(list(texts.items()))).collect()}
    assert got[20].spans == "password:5:17" and got[23].spans == ""
    assert got[21].spans == "assign:0:27" and got[21].n_assign == 1
    assert got[22].spans == "password:13:23"
    clean = {r.doc_id: r for r in secret_scan.redact_secrets(docs_frame(list(texts.items()))).collect()}
    assert clean[20].text == "pwd: [secret] and pwd: changeme" and clean[21].text == "[secret] here" and clean[23].text == texts[23]
    assert all(r.n_chars == len(r.text) for r in clean.values())
    assert [r.spans for r in secret_scan.find_secrets(odd_docs).collect()] == [""] * 10
    assert secret_scan.redact_secrets(odd_docs).where("text IS NULL").count() == 2
    assert secret_scan.find_secrets(odd_docs.limit(0)).collect() == []


def test_secrets_are_whole(spark, docs_frame):
    long = "aB3$" * 150
    texts = {30: 'password: "Summer2024!xQ&7" x', 31: "userPassword=Summer2024!xQ&7 x", 32: f"pwd: {long} end", 33: f"see https://me:{long}@host/x", 34: f"Bearer {'aB3z' * 1500} end",
             35: "token=ftp://me:Zq8,rT5!@host end", 36: "token: 'abcdef0!Kq9&vT' end", 37: "pwd: zz0123456789abcdef0123456789abcdefQ! end"}
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs_frame(list(texts.items()))).collect()}
    assert clean[30] == '[secret]" x' and clean[31] == "user[secret] x" and clean[32] == "pwd: [secret] end" and clean[33] == "see https://me:[secret]@host/x"
    assert clean[34] == "Bearer [secret] end" and clean[35] == "token=[secret]@host end" and clean[36] == "[secret]' end" and clean[37] == "pwd: [secret] end"
    base, added = secret_scan.scan(texts[30], 8)
    assert base == plain_secrets(texts[30]) and added == [("password", 11, 26)]


def test_words_of_the_documents_are_no_secrets(spark, docs_frame):
    plain = "the login is available, a token is generated, pass: through gates, secret is discovered, token: wiederherstellung"
    prose = "through available gates a generated thing was discovered and wiederherstellung kam"
    rows = [(40, plain), (41, "pwd: hgwqzkfjtr and pwd: through"), (42, prose), (None, plain), (43, "password: discovered-hgwqzkfjtr!")]
    got = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs_frame(rows)).collect()}
    assert got[40] == got[None] == plain.replace("token: wiederherstellung", "[secret]") and got[42] == prose  # the base pattern stays
    assert got[41] == "pwd: [secret] and pwd: through" and got[43] == "[secret]"
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs_frame(rows)).collect()}
    assert spans[40] == spans[None] and "password" not in spans[40] and spans[41] == "password:5:15"


def test_every_masked_address_is_proposed():
    for a in ("at", "AT", " at ", " AT "):
        for left, right in ("()", "[]", "{}", "<>"):
            for t in (f"jane {left}{a}{right} site.org", f"jane{left}{a}{right}site {left}dot{right} org"):
                assert pii.scan(t)[1] == [("email", 0, len(t))], t
    for t in (f"{'j' * 100} (at) site.org", f"jane (at) {'s' * 100}.{'o' * 70}"):
        assert pii.scan(t)[1] == [("email", 0, len(t))], t
    assert pii.scan("(at)" * 50_000 + "a" * 200_000 + " (at) " + "a" * 200_000) == ([], [])


def test_selection_of_overlapping_spans_equals_plain_search():
    import random
    import time

    from leafgrade.llm.pii import select

    rng = random.Random(8)
    for _ in range(300):
        span = lambda: (rng.choice(["email", "phone"]), b := rng.randint(0, 60), b + rng.randint(1, 9))
        base, scored = [span() for _ in range(rng.randint(0, 5))], [(rng.randint(0, 4) / 4, span()) for _ in range(rng.randint(0, 25))]
        want = []
        for _, s in sorted(scored, key=lambda c: (-c[0], c[1])):
            if all(s[2] <= b or e <= s[1] for _, b, e in base + want):
                want.append(s)
        assert select(base, scored) == want
    start = time.perf_counter()
    assert len(select([], [(rng.random(), ("phone", 20 * i, 20 * i + 12)) for i in range(100_000)])) == 100_000
    assert time.perf_counter() - start < 20


def test_thresholds_do_not_depend_on_the_layout(spark, docs_frame):
    from leafgrade.llm.pii import fit_trees, training_set

    docs = docs_frame([(i % 250, f"call +49 170 55{i:05d} or mail m{i}@site{i}.org card 4539 1488 0343 {i:04d} 10.0.{i % 300}.7") for i in range(300)])
    cuts = [fit_trees(spark, training_set(docs.repartition(n), 100, 5), 0.99, 5)["cut"] for n in (2, 7)]
    assert cuts[0] == cuts[1]
