import hashlib
import random
import re

import numpy as np

from terrastrata.llm import pii as P


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    r = random.Random(4)
    bits = ["a.b", "@", "x-1", ".com", "..", "%+", "1", "25", "255", "256", ".", "-", " ", "+", "(", ")", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-0100", "name.1@mail.example.com", "10.0.0.1", "\n", "٣", "0001"]
    return [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(600)), "a" * 30_000 + "@", "1" * 4000, "+" * 5000, "1." * 5000, "a@b" * 5000, "a@b.c@d.e"]


def test_query_equals_brute_force(spark, docs_of, saved):
    ts = texts()
    got = P.op10_pii(spark, saved(documents=docs_of(ts)))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {x.doc_id: x for x in got.collect()}
    assert len(rows) == len(ts)
    for i, t in enumerate(ts):
        want = brute(t)
        assert tuple(rows[i])[1:5] == tuple(sum(k == j for _, k, _ in want) for j in range(4)), (t, want)
        assert rows[i].base_sha256 == hashlib.sha256(P.listed(want).encode()).hexdigest()
        assert set(filter(None, P.listed(want).split(","))) <= set(rows[i].spans.split(","))


#: Sentences in the words and forms of none of the training's: (text, the spans in it by type).
HELD_OUT = [
    ("Dear Ms Okafor, you may reach the office under 0171 2345678, or ring 030 4567 8901 after six.", [("phone", "030 4567 8901")]),
    ("Our landline: +33 1 42 68 53 00 (weekdays only).", [("phone", "+33 1 42 68 53 00")]),
    ("phone 07700 900123", [("phone", "07700 900123")]),
    ("Customer service (800) 555-0199 will help.", [("phone", "(800) 555-0199")]),
    ("bob [at] mail [dot] com", [("email", "bob [at] mail [dot] com")]),
    ("Replies go to jane.doe(at)university(dot)edu by Friday.", [("email", "jane.doe(at)university(dot)edu")]),
    ("Her address is h.smith at research dot org, she says.", [("email", "h.smith at research dot org")]),
    ("<support@shop.example.org> wrote:", [("email", "support@shop.example.org")]),
    ("Please transfer to GB82 WEST 1234 5698 7654 32 today.", [("iban", "GB82 WEST 1234 5698 7654 32")]),
    ("Kontonummer DE89370400440532013000, Verwendungszweck Miete", [("iban", "DE89370400440532013000")]),
    ("FR14 2004 1010 0505 0001 3M02 606 is where the rent goes", [("iban", "FR14 2004 1010 0505 0001 3M02 606")]),
    ("The applicant, SSN 219-09-9999, was born in May.", [("national_id", "219-09-9999")]),
    ("Tax file of J. Doe: 457-55-5462.", [("national_id", "457-55-5462")]),
    ("eth0 has hwaddr 00:1A:2b:3C:4d:5E and is up", [("mac", "00:1A:2b:3C:4d:5E")]),
    ("aa:bb:cc:dd:ee:ff left the network", [("mac", "aa:bb:cc:dd:ee:ff")]),
    ("Paid with 5555 5555 5555 4444 on Monday", [("card", "5555 5555 5555 4444")]),
    ("visa 4111-1111-1111-1111 exp 09/27", [("card", "4111-1111-1111-1111")]),
    ("ping 192.168.0.17 failed twice", [("ip", "192.168.0.17")]),
    ("On 2024-05-06 version 1.2.3 cost 45 and took 12:30.", []),
    ("Founded in 1987, it employs 12,500 people in 34 countries.", []),
    ("Section 3.1.4.1.5 follows RFC 2616, pages 101-117.", [("ip", "3.1.4.1")]),  # so the base pattern has it
    ("ISBN 978-3-16-148410-0, third printing", []),
    ("We met [at] noon, (at) last", []),
    ("The score at half time was 14 at home, dot after dot.", []),
    ("Invoice 20240506 of 1234.50 EUR, order 0012345678", []),
    ("sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709 matches", []),
    ("The temple stands at 37.9715, 23.7267 above the city", []),
    ("Case 000-12-3456 and lot 987-65-4321 were void", []),
    ("At 10:20:30 the count was 4,294,967,295 rows", []),
    ("Thanks @maria and user@localhost!", []),
]


def test_field_on_held_out_sentences():
    field = P.trained()
    hit = found = true = 0
    for text, want in HELD_OUT:
        _, all_ = P.spans(text, field)
        got = {(P.TYPES[k], text[a:b]) for a, k, b in all_}
        hit, found, true = hit + len(got & set(want)), found + len(got), true + len(want)
    assert hit / found >= 0.9 and hit / true >= 0.9, (hit, found, true)


def every_way(tokens):
    """All segmentations of a short sentence: lists of (start, end, label)."""
    segments = {}
    for i, j, _ in P.candidates(tokens):
        segments.setdefault(i, []).append(j)

    def after(at):
        if at == len(tokens):
            return [[]]
        out = [[(at, at + 1, 0), *x] for x in after(at + 1)]
        for j in segments.get(at, ()):
            out += [[(at, j, k + 1), *x] for x in after(j) for k in range(len(P.TYPES))]
        return out

    return after(0)


def test_normaliser_and_gradient():
    """The recursions against the sum over all segmentations, and the gradient against differences."""
    sentences = [("ip 10.0.0.1", [(3, 11, "ip")]), ("a 1234 b1234", []), ("x@y.de,5555", [(0, 6, "email")])]
    data = P.lattice(sentences, least=1)
    r = np.random.default_rng(3)
    weights, follow = r.normal(size=(len(data.names), len(P.TYPES))), r.normal(size=(len(P.TYPES) + 1,) * 2)
    value, gradient, moves, total = P.likelihood(data, weights, follow)
    field = P.Field(dict(zip(data.names, weights, strict=True)), follow)
    texts = sorted((t for t, _ in sentences), key=lambda t: -len(P.TOKEN.findall(t)))
    for n, text in enumerate(texts):
        tokens = P.TOKEN.findall(text)
        scores = {(i, j, k + 1): x for i, j, s in field.scores(tokens) for k, x in enumerate(s)}
        ways = [sum(scores.get(x, 0.0) for x in way) + sum(follow[a][b] for a, b in zip([0, *(x[2] for x in way)], (x[2] for x in way), strict=False)) for way in every_way(tokens)]
        assert abs(np.logaddexp.reduce(ways) - total[n]) < 1e-9
    for array, got in ((weights, gradient), (follow, moves)):
        for _ in range(12):
            at = tuple(r.integers(x) for x in array.shape)
            step = np.zeros_like(array)
            step[at] = 1e-5
            up, down = (P.likelihood(data, *((weights + s * step, follow) if array is weights else (weights, follow + s * step)))[0] for s in (1, -1))
            assert abs((up - down) / 2e-5 - got[at]) < 1e-4


def test_decoding_is_the_best_of_all():
    field = P.trained()
    for text in ("call 212-555-0123", "x@y.de,5555", "ssn 123-45-6789"):
        tokens = P.TOKEN.findall(text)
        scores = {(i, j, k + 1): x for i, j, s in field.scores(tokens) for k, x in enumerate(s)}

        def worth(way, scores=scores):
            labels = [0, *(x[2] for x in way)]
            return sum(scores.get(x, 0.0) for x in way) + sum(field.follow[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(every_way(tokens), key=worth)
        assert field.decode(tokens) == [(i, j, k - 1) for i, j, k in best if k]


def test_added_spans_leave_base_alone():
    field = P.trained()
    base, all_ = P.spans("write to a [at] b [dot] com, ssn 123-45-6789, ip 10.0.0.1", field)
    assert [P.TYPES[k] for _, k, _ in base] == ["ip"]
    assert [P.TYPES[k] for _, k, _ in all_] == ["email", "national_id", "ip"]
    for text in texts():
        base, all_ = P.spans(text or "", field)
        added = [x for x in all_ if x not in base]
        assert all(b <= x or a >= y for a, _, b in added for x, _, y in base) and len(all_) == len(base) + len(added)


def test_regions_reach_all_that_a_line_holds():
    """Near triggers or over whole lines, the field finds the same."""
    field, maker = P.trained(), P.Maker(31)
    for _ in range(150):
        text = "\n".join(" ".join(["lore ipsum dol"] * 20 + [maker.sentence()[0]] + ["sit amet nec"] * 20) for _ in range(2))
        whole, at = [], 0
        for line in text.split("\n"):
            tokens = P.TOKEN.findall(line)
            starts = [at]
            for t in tokens:
                starts.append(starts[-1] + len(t))
            whole += [(starts[i], k, starts[j]) for i, j, k in field.decode(tokens)]
            at += len(line) + 1
        base = P.base_spans(text)
        assert set(P.spans(text, field)[1]) == {x for x in whole if all(x[2] <= a or x[0] >= b for a, _, b in base)} | set(base)


def test_empty_table(spark, docs_of, saved):
    assert P.op10_pii(spark, saved(documents=docs_of(["x"]).limit(0))).collect() == []


def test_repeated_rows_and_clashing_columns(spark, docs_of, saved):
    text = "ssn 219-09-9999, mail a@b.de"
    docs = docs_of([text, text, None], ids=[4, 4, None]).withColumnRenamed("fp", "spans")
    rows = P.op10_pii(spark, saved(documents=docs)).collect()
    assert sorted((x.doc_id or -1, x.n_email, x.spans) for x in rows) == [(-1, 0, ""), (4, 1, "national_id:4:15,email:22:28"), (4, 1, "national_id:4:15,email:22:28")]
