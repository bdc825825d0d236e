import random
import re
import zlib
from hashlib import sha256

import pytest
from helpers import awkward, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from folioq.llm import matroska as mk
from folioq.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def plain_secrets(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab1.@+- ()5%_,é９\n", "4111 1111 1111 1111", "+1 (202) 555-0100", "10.0.0.1", "x@y.zz"]), max_size=40))
def test_base_identifiers(parts):
    t = "".join(parts)
    assert pii.identifiers(t) == plain_pii(t)
    base, more = pii.find_pii(t)
    assert base == plain_pii(t) and all(0 <= s < e <= len(t) for _, s, e in more)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "token", "api_key", "apikey", "=", " ", ":", '"', "abcdefgh", "x", "é", "ſecret", "AKIA", "AKIAABCDEFGHIJKL", "0" * 32, "f"]), max_size=14))
def test_base_secrets(parts):
    t = "".join(parts)
    assert secrets.find_secrets(t) == plain_secrets(t)


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("mail: john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("bob at mail dot example dot org", "email", "bob at mail dot example dot org"),
        ("j.doe (at) foo.com.", "email", "j.doe (at) foo.com"),
        ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("at １９２.１６８.１.１ x", "ip", "１９２.１６８.１.１"),
        ("ip one nine two dot one six eight dot one dot one!", "ip", "one nine two dot one six eight dot one dot one"),
        ("us​er@host.com", "email", "us​er@host.com"),
    ],
)
def test_disguises(text, kind, shown):
    base, more = pii.find_pii(text)
    assert (kind, text.index(shown), text.index(shown) + len(shown)) in more
    assert shown not in pii.masked(text) and f"[{kind.upper()}]" in pii.masked(text)


@pytest.mark.parametrize("text", ["he is at home dot he", "meet at the dot com boom", "one two three four", "Look at this. Dot the i.", "привет, как дела"])
def test_clean_texts(text):
    assert pii.find_pii(text) == ([], []) and pii.masked(text) == text


def test_long_texts_take_linear_time():
    for t in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 300_000, " " * 500_000 + "[at] dot", "one two " * 50_000, "password " * 50_000, "+1" * 300_000):
        pii.find_pii(t)
        secrets.find_secrets(t)


def test_checksummed_tokens():
    body = "abcdefghijABCDEFGHIJ0123456789"
    good = f"ghp_{body}{secrets.checksum(body.encode()).decode()}"
    assert secrets.find_secrets(f"é {good}.") == [("github", 2, 42)]
    assert secrets.find_secrets(f"é {good[:-1]}{'0' if good[-1] != '0' else '1'}.") == []
    assert secrets.find_secrets(good.replace("ghp_", "npm_")) == [("npm", 0, 40)]


def test_tables(spark):
    df = awkward(spark)
    src = {r.doc_id: r.text or "" for r in df.collect()}
    for out, kinds in ((pii.pii_spans(df), pii.KINDS), (secrets.secret_spans(df), secrets.BASE)):
        rows = out.collect()
        assert len(rows) == df.count() and all(r.base_sha256 == sha256(b"").hexdigest() and r.spans == "" and r[f"n_{kinds[0]}"] == 0 for r in rows)
    masked = pii.masked_documents(df)
    assert masked.schema == df.schema and masked.collect() == df.collect() and src
    one = spark.createDataFrame([(1, "é a@b.cc +12025550100 token=abcdefgh1")], "doc_id long, text string")
    r = pii.pii_spans(one).first()
    assert (r.n_email, r.n_phone, r.spans) == (1, 1, "email:2:8,phone:9:21") and r.base_sha256 == sha256(r.spans.encode()).hexdigest()
    assert secrets.secret_spans(one).first().spans == "assign:22:37"
    for f in (pii.pii_spans, secrets.secret_spans, pii.masked_documents, mk.text_media):
        assert f(nothing(spark)).count() == 0


def test_media_round_trip(spark):
    rng = random.Random(5)
    for n in (0, 1, 63, 64, 65, 512, 4096, 4097, 40_000, 300_001):
        t = "".join(rng.choice("abcé\n ") for _ in range(n))
        media, size = mk.stored(t)
        payload, feature = mk.read_back(media)
        raw = t.encode()
        assert size == len(raw) and payload == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        m = mk.parse(media)
        assert m.doc_type == "matroska" and m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.tracks[1]["bits"] == 8
        assert [p[1] for p in m.packets] == [i * 64_000_000 for i in range(len(m.packets))]
        assert len(m.cues) == m.clusters and f"cues={m.clusters};" in feature
    df = awkward(spark)
    rows = mk.text_media(df).collect()
    assert sorted(r.payload_sha256 for r in rows) == sorted(sha256((x := (r.text or "").encode()).ljust(max(64, -(-len(x) // 64) * 64), b"\0")).hexdigest() for r in df.collect())
    empty = next(r for r in rows if r.n_bytes == 0)
    assert empty.payload_bytes == 64 and empty.tail_crc32 == zlib.crc32(bytes(64))


@pytest.mark.parametrize("lacing, sizes", [("none", [700]), ("xiph", [0, 255, 256, 510, 3]), ("fixed", [40] * 9), ("ebml", [10, 10_000, 3, 3, 70_000, 1]), ("ebml", [5]), ("xiph", [9])])
def test_lacing(lacing, sizes):
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    block = mk._block(5, -7, frames, lacing)
    track, relative, key, name, got = mk.frames_of(block, 0, len(block))
    assert (track, relative, key, name) == (5, -7, True, lacing) and [block[a : a + n] for a, n in got] == frames


def test_packet_table(spark):
    media, _ = mk.stored("x" * 9000)
    at = media.index(mk._id(mk.CLUSTER))
    unknown = media[: at + 4] + b"\x01\xff\xff\xff\xff\xff\xff\xff" + media[at + 4 + len(mk.vint(1 << 13)) :]
    rows = spark.createDataFrame([("a", media), ("b", media[:-9]), ("c", None), ("d", b""), ("e", b"\x00junk"), (None, media)], "doc_id string, media binary")
    got = mk.packet_table(rows).collect()
    ok = [r for r in got if r.key == "a"]
    assert len(ok) == 18 and b"".join(media[r.start : r.start + r.size] for r in ok) == b"x" * 9000 + bytes(9024 - 9000)
    assert {r.key for r in got if r.error} == {"b", "e"} and len([r for r in got if r.key is None]) == 18
    assert unknown


@pytest.mark.parametrize("gap", [a + b + c for a in " ,-" for b in ("", " ", ",", "-") for c in ("", " ", ",", "-")])
def test_spelled_digits_with_every_separator(gap):
    shown = gap.join("plus four nine one five five five one two three four".split())
    for text in (f"call {shown}.", shown, f"call {shown.upper()}."):
        start = 0 if text == shown else 5
        assert ("phone", start, start + len(shown)) in pii.find_pii(text)[1] and pii.masked(text).count("[PHONE]") == 1


def test_words_that_only_case_folding_makes_digits():
    assert pii.find_pii("call one two three, one two ſix, fıve six seven now") == ([], [])


@pytest.mark.parametrize("local", ["john.smith", "anna.schmidt", "user7", "bob123", "jane.doe", "a.b", "x_y", "first.middle.lastname", "bob+lists", "7of9", "j2"])
@pytest.mark.parametrize("domain", ["example.com", "example.it", "example.co", "example.info", "mail.example.co.uk", "x.photography", "example.xn--p1ai"])
def test_plain_at_after_a_clear_local_part(local, domain):
    for shown in (f"{local} at {domain}", f"{local}  AT {domain}", f"{local}\u2003at\xa0\x1f{domain}"):
        text = f"write ({shown}) or wait"
        assert ("email", 7, 7 + len(shown)) in pii.find_pii(text)[1] and pii.masked(text) == "write ([EMAIL]) or wait"


@pytest.mark.parametrize("text", ["read more at example.com", "in 2024 at example.com", "for 19.99 at example.com", "the 3rd at example.com, 5pm at example.com", "john.smith at home. Then", "user7 at work"])
def test_plain_at_after_other_words(text):
    assert pii.find_pii(text) == ([], []) and pii.masked(text) == text


def test_plain_at_takes_linear_time():
    for t in ("1a" * 1_000_000 + " at example.com", "a1 at " * 300_000, "a1 at b." * 200_000, "a1 at " + "b." * 500_000, "a1 at " + "b" * 1_000_000):
        pii.find_pii(t)


def test_spelled_numbers_keep_their_place():
    """Long spelled numbers stay where they are, whatever other disguises are undone around them."""
    text = "write to joe [at] foo [dot] com or call five five five one two three four five six seven now, or ann [at] bar [dot] org"
    _, more = pii.find_pii(text)
    assert [(k, text[s:e]) for k, s, e in more] == [("email", "joe [at] foo [dot] com"), ("email", "ann [at] bar [dot] org"), ("phone", "five five five one two three four five six seven")]
    assert pii.masked(text) == "write to [EMAIL] or call [PHONE] now, or [EMAIL]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two ", "dot ", "plus ", "five, ", "six-", "seven. ", "x ", "joe [at] foo [dot] com ", "a@b.cc ", "é", "о", "10.0.0.1 ", "bob at mail dot example dot org ", "٣"]), max_size=30))
def test_spans_lie_in_the_text(parts):
    t = "".join(parts)
    base, more = pii.find_pii(t)
    assert all(0 <= s < e <= len(t) and t[s:e].strip() == t[s:e] for _, s, e in base + more)
    spans = {k: [(s, e) for kind, s, e in base if kind == k] for k in pii.KINDS}
    assert not any(s <= a and z <= e for k, a, z in more for s, e in spans[k])


@pytest.mark.parametrize("part", ["one dot ", "a@b.cc x [at] y [dot] com ", "one two three ", "one two three four five six seven eight nine zero, ", "a@b.cc 10.0.0.1 ", "plus one ", "six. "])
def test_disguises_take_linear_time(part):
    import time

    took = []
    for n in (4000, 16_000):
        t = part * n + "joe [at] foo [dot] com"
        best = min(_timed(lambda: pii.masked(t), time.perf_counter) for _ in range(3))
        took.append(best)
    assert took[1] < 10 * took[0] + 0.2


def _timed(act, clock):
    began = clock()
    act()
    return clock() - began
