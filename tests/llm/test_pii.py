import random
import re
import time

import pytest

from lockstep.llm import pii
from tests.llm.brute import ODD_ROWS

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [c for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn("".join(digits))
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if holds(k, m.group())]


def test_plain_spans_are_the_definition():
    rng = random.Random(2)
    bits = ["1", "2", "25", "9", "0", "300", ".", ".", "@", "a", "b-", ".c", " ", "-", "+", "(", ")", "4111111111111111", "é"]
    for _ in range(30_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 22)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("mail me john [at] example [dot] com ok", "email", "john [at] example [dot] com"),
    ("write john dot doe at example dot co dot uk", "email", "john dot doe at example dot co dot uk"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jо​hn@example.com", "email", "jо​hn@example.com"),
    ("call plus four nine one seven two three four five six seven eight now", "phone", "plus four nine one seven two three four five six seven eight"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("at one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"), ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ("é +٤٩ ١٧٢ ٣٤٥ ٦٧٨٩", "phone", "+٤٩ ١٧٢ ٣٤٥ ٦٧٨٩"),
])
def test_disguises_are_found_in_the_source(text, kind, part):
    at = text.index(part)
    assert (kind, at, at + len(part)) in pii.all_spans(text)


@pytest.mark.parametrize("text", ["he was at home and made a point of it", "un deux trois", "one dot two", "look at them [at] least",
                                  "one of the two or three at dot com", "plus one", "русский текст без данных"])
def test_prose_has_none(text):
    assert pii.all_spans(text) == []


def test_plain_spans_stay_among_all():
    rng = random.Random(4)
    bits = ["john", "@", " at ", " dot ", "example", ".com", " one", " two", "[at]", "(dot)", "1.2.3.4", "+1 555 123 4567", "о", " ", "​", "9"]
    for _ in range(5_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        spans = pii.all_spans(text)
        assert set(pii.plain_spans(text)) <= set(spans) and len(set(spans)) == len(spans)
        assert all(0 <= s < e <= len(text) for _, s, e in spans)


def test_odd_rows(docs_of):
    out = pii.find_pii(docs_of(ODD_ROWS + [(30, "a@b.c"), (30, "a@b.c")])).collect()
    assert len(out) == len(ODD_ROWS) + 2
    assert sum(len(r["spans"]) for r in out) == 2 and {r["doc_id"] for r in out} == {i for i, _ in ODD_ROWS} | {30}
    assert pii.find_pii(docs_of([])).collect() == []
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "one " * 50_000, " " * 200_000, "1.2." * 50_000):
        pii.all_spans(text)


def ungated(text):
    """all_spans with every text rewritten, whatever disguised() says of it."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "disguised", lambda _: True)
        return pii.all_spans(text)


def test_spoken_at_with_plain_dots():
    for text, part in (("write to john at example.com", "john at example.com"), ("john arroba example.com.mx now", "john arroba example.com.mx"),
                       ("a john\nÄT example.de", "john\nÄT example.de"), ("to john@example punkt com", "john@example punkt com")):
        at = text.index(part)
        assert pii.all_spans(text) == [("email", at, at + len(part))], text
    assert pii.all_spans("he stayed at home.  Then at 5.30 he left") == ungated("he stayed at home.  Then at 5.30 he left")


def test_the_look_misses_no_spoken_address():
    rng = random.Random(6)
    bits = ["john", "doe", "x9", "@", " at ", "\tAT ", " arroba ", "\nät ", " dot ", " poİnt ", ".", ". ", "example", ".com", " ", "\n", "-", ",", "9", " punKt ", "é"]
    for _ in range(60_000):
        text = "".join(rng.choices(bits, k=rng.randint(2, 10)))
        assert pii.all_spans(text) == ungated(text), text


def test_spelled_digits_beside_marks():
    for text, kind, part in (("+1 555 867 five three zero nine, thanks", "phone", "+1 555 867 five three zero nine"),
                             ("it is 'one dot two dot three dot four', yes", "ip", "one dot two dot three dot four"),
                             ("tel:plus four nine 1234567 five six/x", "phone", "plus four nine 1234567 five six"),
                             ("é \"one dot two dot three dot ſix\"", "ip", "one dot two dot three dot ſix")):
        at = text.index(part)
        assert (kind, at, at + len(part)) in pii.all_spans(text), text
    assert not pii.disguised("one, or two; then three words and four")


def test_the_look_misses_no_spelled_digits():
    rng = random.Random(7)
    bits = ["one", "two", "Three", "FÜNF", "ſix", "fıve", "NİNE", "un", "plus", "+", "12", "7", "٣", "dot", "point", "at", "x", "é", "_", "@", "com"]
    marks = [" ", " ", " ", "  ", ".", ",", ":", "/", "'", '"', "-", "(", ") ", "", ";", "\n", "[", "]"]
    for _ in range(60_000):
        text = "".join(rng.choice(bits[:9] if rng.random() < 0.7 else bits) + rng.choice(marks) for _ in range(rng.randint(4, 12)))
        assert pii.all_spans(text) == ungated(text), text


#: Spoken addresses as one pattern, which tries every start anew.
WHOLE = re.compile(
    rf"(?:(?<=[a-z0-9])\s++(?:{pii._DOTS})\s++[a-z0-9-]++)*(?<=[a-z0-9])(?:\s++(?:{pii._ATS})\s++|@)[a-z0-9-]++(?:(?:\s++(?:{pii._DOTS})\s++|\.)[a-z0-9-]++)+", re.I)


def test_spoken_addresses_are_those_of_the_whole_pattern():
    rng = random.Random(12)
    bits = ["dot", "punkt", "at", "AT", "a", "b1", "x-y", "@", ".", "com", "ſ", "-", "é", "(", "Dot"]
    found = 0
    for _ in range(40_000):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randint(1, 14)))
        want = [m.span() for m in WHOLE.finditer(text)]
        assert list(pii._spoken_addresses(text)) == want, text
        found += len(want)
    assert found > 500


def test_spoken_addresses_take_linear_time():
    def seconds(n):
        text = "a dot " * n + "at nothing here о"
        best = []
        for _ in range(3):
            start = time.process_time()
            assert pii.all_spans(text) == []
            best.append(time.process_time() - start)
        return min(best)

    assert seconds(40_000) < 6 * max(seconds(10_000), 0.005)
