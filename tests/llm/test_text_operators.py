"""Quality rules, pseudonyms, tokens, media, URLs, chats: against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, WORD, make_docs
from pyspark.sql import functions as F

from folioflow.llm import chat_format, jpeg, pii, quality_rules, sentencepiece_codec, url_filters
from folioflow.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a", "the cat\nthe cat\n\nthe cat", "x " * 50, "a b c d e f a b c d e g", "# * $ % & | < >", "\u00e9t\u00e9 \U0001f600\n" * 3]


def frame(spark, texts, **extra):
    return spark.createDataFrame([(k, t, None, "s", 0) for k, t in enumerate(texts)], SCHEMA)


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = TEXTS + [r[1] for r in make_docs()]
    got = quality_rules.verdicts(quality_rules.measure(frame(spark, texts))).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        want = measures(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.kept and row.base_failed)


def test_quality_leaves_clean_texts_alone(spark):
    """Other scripts, very long texts and a line that comes twice among few."""
    texts = [
        " ".join(f"\u0441\u043b\u043e\u0432\u043e{k}" for k in range(200)),
        " ".join(f"the word{k}" for k in range(120_000)),
        "\n".join(["Chapter one of it", *(" ".join(f"the w{k}x{j}" for j in range(40)) for k in range(2)), "Chapter one of it"]),
        " ".join(f"latin{k}" for k in range(200)),
    ]
    got = quality_rules.verdicts(quality_rules.measure(frame(spark, texts))).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True, True, False] and got[3].broken_rules == ["enough_stop_words"]


def test_quality_filter_keeps_columns(docs, no_docs):
    extra = docs.withColumns({"n_words": F.lit("mine"), "__row": F.lit(1), "kept": F.lit(False)})
    kept = quality_rules.keep_good(extra)
    assert kept.columns == extra.columns and kept.filter("n_words = 'mine'").count() == kept.count() > 0
    assert quality_rules.keep_good(no_docs).count() == 0


def test_permutation_is_one_to_one(spark):
    moved = spark.range(7 * 11).select(pii.permute(F.col("id"), 7, 11, pii.Hmac(b"k"), "t").alias("p"))
    assert sorted(r.p for r in moved.collect()) == list(range(77))
    digits = spark.range(100).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 2, "0"), pii.Hmac(b"k"), "t").alias("p"))
    assert len({r.p for r in digits.collect()}) == 100


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    text = 'mail Ann.Lee@mail.example or call +1 (212) 555-0100, ip 10.1.2.3, on 2020-02-29, ssn 123-45-6789, card 4111 1111 1111 1111. key = "AbCd1234efgh" bad 999-00-0000 and 4111 1111 1111 1112'
    rows = pii.pseudonymise(frame(spark, [text, "again 4111111111111111 and Ann.Lee@mail.example", None, "", "plain text"])).orderBy("doc_id").collect()
    one, two, none, empty, plain = (r.text for r in rows)
    assert none is None and empty == "" and plain == "plain text"
    without_ip = re.compile(r"ip [\d.]+")  # an address stays an address; its length may change
    assert len(without_ip.sub("", one)) == len(without_ip.sub("", text)) and one != text
    assert all(gone not in one for gone in ("4111 1111 1111 1111.", "10.1.2.3", "2020-02-29", "123-45-6789", "555-0100", "Ann.Lee", "AbCd1234efgh"))
    assert "999-00-0000" in one and "4111 1111 1111 1112" in one
    card = re.search(r"card ([\d ]{19})\.", one)[1]
    assert luhn(card.replace(" ", "")) and card.replace(" ", "") in two
    assert re.search(r"mail (\S+@\S+) or", one)[1] in two
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", re.search(r"on (\S+),", one)[1])
    assert max(map(int, re.search(r"ip ([\d.]+),", one)[1].split("."))) < 256


class Feistel:
    """The pseudonyms of single values in plain Python."""

    def __init__(self, key):
        self.key = key

    def number(self, *parts):
        import hmac

        return int(hmac.new(self.key, "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:15], 16)

    def numbers(self, x, y, a, b, *kind):
        for k in range(pii.ROUNDS):
            if k % 2 == 0:
                x = (x + self.number(*kind, k, y)) % a
            else:
                y = (y + self.number(*kind, k, x)) % b
        return x, y

    def rank(self, rank, a, b, kind):
        x, y = self.numbers(rank // b, rank % b, a, b, kind)
        return x * b + y

    def digits(self, text, kind):
        n, left = len(text), len(text) // 2
        x, y = self.numbers(int(text[:left]), int(text[left:]), 10**left, 10 ** (n - left), kind, n)
        return f"{x:0{left}d}{y:0{n - left}d}"

    def characters(self, text, kind, letters=26):
        import hmac

        low, n = text.lower(), len(text)
        sides = [low[: n // 2], low[n // 2 :]]
        for k in range(pii.ROUNDS):
            side, other = sides[k % 2], sides[1 - k % 2]
            stream = b"".join(hmac.new(self.key, f"{kind}|{n}|{k}|{b}|{other}".encode(), hashlib.sha256).digest() for b in range(len(side) // 32 + 1))
            move = lambda c, r: chr((ord(c) - 48 + r) % 10 + 48) if c.isdigit() else chr((ord(c) - 97 + r) % letters + 97) if c.isalpha() else c
            sides[k % 2] = "".join(map(move, side, stream))
        return "".join(c.upper() if o.isupper() else c for c, o in zip("".join(sides), text))


def card_pseudonym(feistel, card):
    payload = feistel.digits(card[:-1], "card")
    return next(payload + d for d in "0123456789" if luhn(payload + d))


def test_pseudonyms_equal_plain_python(spark):
    import datetime as dt

    f = Feistel(pii.DEFAULT_KEY)
    day = lambda text: str(dt.date(1800, 1, 1) + dt.timedelta(f.rank((dt.date.fromisoformat(text) - dt.date(1800, 1, 1)).days, 189, 773, "date")))
    long_secret = "AbCd1234+/xyz=" * 800
    want = {
        "4111111111111111": card_pseudonym(f, "4111111111111111"),
        "2020-02-29": day("2020-02-29"),
        "1850-01-01": day("1850-01-01"),
        "Ann.Lee_7@mail.example": f.characters("Ann.Lee_7@mail", "email") + ".example",
        "212-555-0100": (lambda d: f"{d[:3]}-{d[3:6]}-{d[6:]}")(f.digits("2125550100", "phone")),
        'key = "AbCd1234-efgh"': f'key = "{f.characters("AbCd1234-efgh", "secret")}"',
        'key = "ABCDEF0123456789"': f'key = "{f.characters("ABCDEF0123456789", "hex", 6)}"',
        f"token={long_secret}": f"token={f.characters(long_secret, 'secret')}",
        "password     =      'correcthorse'": f"password     =      '{f.characters('correcthorse', 'secret')}'",
        f"{'a.b' * 500}@x.{'y' * 200}.museum": f.characters(f"{'a.b' * 500}@x.{'y' * 200}", "email") + ".museum",
        f"w@{'d.' * 20000}com": f.characters(f"w@{'d.' * 20000}"[:-1], "email") + ".com",
    }
    ip = f.rank(10 << 24 | 1 << 16 | 2 << 8 | 3, 1 << 16, 1 << 16, "ip")
    want["10.1.2.3"] = ".".join(str(ip >> k & 255) for k in (24, 16, 8, 0))
    area, group, serial = 123, 45, 6789
    rank = f.rank(((area - 1) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    low = rank // (99 * 9999) + 1
    want["123-45-6789"] = f"{low + (low >= 666):03d}-{rank // 9999 % 99 + 1:02d}-{rank % 9999 + 1:04d}"
    texts = [f"see {v} now" for v in want]
    assert pseudonyms(spark, texts) == [f"see {v} now" for v in want.values()]


def test_pseudonyms_with_clashing_names(spark):
    clash = {n: F.lit("212-555-0100") for n in ("found", "between", "new", "row", "__found", "__new")}
    rows = pii.pseudonymise(frame(spark, ["call 212-555-0100", None]).withColumns(clash))
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
    assert {tuple(r[n] for n in clash) for r in rows.collect()} == {("212-555-0100",) * len(clash)}


def pseudonyms(spark, texts):
    return [r.text for r in pii.pseudonymise(frame(spark, texts)).orderBy("doc_id").collect()]


def test_pseudonyms_of_cards_beside_numbers(spark):
    card = "4111111111111111"
    texts = [card, f"order 42 {card}", "2024 4111 1111 1111 1111", f"{card} 123", f"{card} 5500005555555559 {card}", f"42 2020-02-29 {card} 10.1.2.3", f"ref-{card}", f"42 {card[:8]} {card[8:]} 7"]
    got = pseudonyms(spark, texts)
    new = got[0]
    assert new != card and luhn(new)
    assert got[1] == f"order 42 {new}" and got[3] == f"{new} 123" and got[6] == f"ref-{new}"
    assert got[2] == "2024 " + " ".join(new[i : i + 4] for i in range(0, 16, 4))
    one, two, three = got[4].split(" ")
    assert one == three == new and two != "5500005555555559" and luhn(two)
    parts = got[5].split(" ")
    assert parts[0] == "42" and parts[1] != "2020-02-29" and parts[2] == new and parts[3] != "10.1.2.3"
    assert got[7] == f"42 {new[:8]} {new[8:]} 7"
    plain = [" ".join(map(str, range(1, 60))), "4111 1111 1111 1112 15", "7 " * 3000, "100 " * 3000, "1" * 20000]
    assert pseudonyms(spark, plain) == plain


def test_pseudonyms_of_phone_layouts(spark):
    layouts = ["+1 (212) 555-0100", "(212) 555-0100", "212-555-0100", "+1-212-555-0100", "1-212-555-0100", "212.555.0100", "+12125550100", "+1 212 555 0100"]
    digits = [re.sub(r"\D", "", t)[-10:] for t in pseudonyms(spark, [f"call {x} or 17 now" for x in layouts]) for t in [t.split(" or ")[0]]]
    assert len(set(digits)) == 1 and digits[0] != "2125550100"
    got = pseudonyms(spark, ["17 +44 20 7946 0958, 18", "+442079460958", "+33 1 42 68 53 00 4111 1111 1111 1111 9", "4111111111111111"])
    assert re.fullmatch(r"17 \+44 \d\d \d{4} \d{4}, 18", got[0]) and "7946 0958" not in got[0]
    assert got[0][3:-4].replace(" ", "") == got[1]
    assert got[2].startswith("+33 ") and "42 68 53" not in got[2] and got[2][18:-2].replace(" ", "") == got[3]


def test_pseudonyms_of_secrets(spark):
    value = "AbCd1234efgh"
    texts = [f'key = "{value}"', f"key = '{value}'", f"api_key={value}", f"password: {value} 99", f'{{"token": "{value}"}}', "password=correcthorse", "key: 2020-02-29", "2020-02-29", "the key: understanding"]
    got = pseudonyms(spark, texts)
    new = got[0][7:-1]
    assert new != value and got[1] == f"key = '{new}'" and got[2] == f"api_key={new}" and got[3] == f"password: {new} 99"
    assert got[4] == f'{{"token": "{new}"}}' and got[5].startswith("password=") and got[5] != texts[5]
    assert got[6] == f"key: {got[7]}" and got[8] == texts[8]


def test_pseudonyms_edges(docs, no_docs):
    assert pii.pseudonymise(docs).columns == docs.columns and pii.pseudonymise(docs).count() == docs.count()
    assert pii.pseudonymise(no_docs).count() == 0


STRANGE = ["Hello  world", " lead", "trail ", "tab\there\nline", "\u2581mark", "na\u00efve \U0001f600 \u4e2d\u6587", "a" * 300, "x" * 60 + " " + "y" * 3000, "\u00a0nbsp", "<s> </s> <unk>", "\x00\x01", "1234567890 " * 20]


def test_tokens_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = TEXTS + STRANGE + [r[1] for r in make_docs(3, 20)]
    got = sentencepiece_codec.encode_texts(frame(spark, texts), tokenizer_path()).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        text = text or ""
        ids = [*library.encode(text), library.eos_id()]
        assert list(row.ids) == ids
        assert row.decoded == library.decode(ids)
        size = len(text.encode())
        assert all(0 <= a <= b <= size for a, b in zip(row.starts, row.ends)) and row.ends[-1] == size
        assert list(row.ends) == sorted(row.ends)


def double_array(entries):
    """A compiled character map: the trie of entries (key: replacement) as a double array, then the replacements."""
    values, pool = {}, b""
    for key, new in entries.items():
        values[key] = len(pool)
        pool += new + b"\0"
    units, taken, offsets = {0: 0}, {0}, set()

    def place(node, prefix):
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        ends = prefix in values
        offset = 1
        # No two nodes have their children from the same place on.
        while node ^ offset in offsets or any((node ^ offset ^ c) in taken for c in [*labels, *([0] if ends else [])]):
            offset += 1
        offsets.add(node ^ offset)
        units[node] |= offset << 10 | (0x100 if ends else 0)
        taken.update(node ^ offset ^ c for c in [*labels, *([0] if ends else [])])
        if ends:
            units[node ^ offset] = values[prefix] | 0x80000000
        for c in labels:
            units[node ^ offset ^ c] = c
        for c in labels:
            place(node ^ offset ^ c, prefix + bytes([c]))

    place(0, b"")
    blob = b"".join(units.get(k, 0xFF).to_bytes(4, "little") for k in range(max(units) + 1))
    return len(blob).to_bytes(4, "little") + blob + pool


MAPPED = {"\u00bd": "1/2", "\ufb01": "fi", "a\u0301": "\u00e1", "a": "a", "\u3000": " ", "\t": " ", "\u200b": "", "abc": "X", "\u4e2d\u56fd": "C"}


def test_character_map_takes_the_longest_prefix():
    entries = {k.encode(): v.encode() for k, v in MAPPED.items()}
    char_map = sentencepiece_codec.CharMap(double_array(entries))
    for text in ("a\u0301b", "ab", "abc", "abd", "\u00bd", "\ufb01x", "zz", "\u4e2d", "\u4e2d\u56fd", "\u200b", "\u3000 "):
        data = text.encode()
        fits = [k for k in entries if data.startswith(k)]
        best = max(fits, key=len, default=None)
        assert char_map.longest(data, 0) == (None if best is None else (entries[best], len(best)))
    assert sentencepiece_codec.CharMap(b"").longest(b"a", 0) is None


@pytest.mark.parametrize("trim", [False, True])
def test_spans_through_the_character_map(trim):
    """Normalised text and its alignment with the source, against a walk over characters."""
    model = sentencepiece_codec.Model(sentencepiece_codec.read_model(tokenizer_path()))
    model.char_map = sentencepiece_codec.CharMap(double_array({k.encode(): v.encode() for k, v in MAPPED.items()}))
    model.trim = trim
    model._forget()
    for text in ("", "plain text", "a\u0301bc abc\u3000\tx", "  \u00bd cup\u200b of \ufb01sh  ", "\u4e2d\u56fd\u4e2d a", "\u200b\u200b", " ", "x\u3000"):
        steps, at = [], 0
        while at < len(text):
            best = max((k for k in MAPPED if text.startswith(k, at)), key=len, default=text[at])
            steps.append((MAPPED.get(best, best), len(text[:at].encode())))
            at += len(best)
        out = [(c, place) for new, place in steps for c in new]
        if trim:
            out = [(c, p) for i, (c, p) in enumerate(out) if c != " " or (i and out[i - 1][0] != " ")]
            if out and out[-1][0] == " ":
                out = out[:-1]
        want = "".join("\u2581" if c == " " else c for c, _ in out)
        if not text or (trim and not out):
            assert model.normalise(text)[0] == ""
            continue
        normal, source = model.normalise(text)
        assert normal == "\u2581" * model.dummy_prefix + want
        aligned = [p for c, p in out for _ in (c if c != " " else "\u2581").encode()]
        assert source[3 * model.dummy_prefix : -1].tolist() == aligned
        (ids, starts, ends), = model.encode_many([text])
        pieces = b"".join(model.pieces[i] if model.kinds[i] != sentencepiece_codec.BYTE else bytes([int(model.pieces[i][3:5], 16)]) for i in ids)
        assert pieces.decode() == normal
        assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(starts, ends)) and starts.tolist() == sorted(starts.tolist())


def test_tokens_of_no_rows(no_docs):
    assert sentencepiece_codec.encode_texts(no_docs, tokenizer_path()).count() == 0


def test_media_round_trip(spark, no_docs):
    texts = TEXTS + ["z" * 191, "z" * 192, "z" * 193, "\u00ff\u0100" * 5000, "q" * (192 * 9000)]
    rows = jpeg.describe(jpeg.store_payloads(frame(spark, texts))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        raw = (text or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(row.thumbnail) == want and row.n_bytes == len(raw) and row.width == 192 * 8
        assert row.height * 192 // 8 == len(want)
    assert rows[-1].n_images == 2
    assert jpeg.describe(jpeg.store_payloads(no_docs)).count() == 0


ZIGZAG_ENDS = (1, 5, 20, 40, 63)


def foreign_jpeg(rng, width, height, sampling, interleaved=True, restart=0, wide_tables=False):
    """A baseline JPEG of random coefficients, AC codes and runs of zeros included, and the DC values of its first component."""
    dc_symbols, ac_symbols = list(range(12)), [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 4))]
    ac_symbols = list(dict.fromkeys(ac_symbols))

    def table(symbols, length):
        """One length for all codes, the all-ones code left free."""
        return {s: (k, length) for k, s in enumerate(symbols)}, bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + bytes(symbols)

    (dc_codes, dc_spec), (ac_codes, ac_spec) = table(dc_symbols, 5), table(ac_symbols, 6)
    step = rng.choice([1, 3, 8, 300 if wide_tables else 16])
    segment = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9))
    for q in range(2):
        values = [step, *[rng.randint(1, 255)] * 63]
        out += segment(0xDB, bytes([q | 0x10 * wide_tables]) + b"".join(v.to_bytes(2 if wide_tables else 1, "big") for v in values))
    out += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([9 - k, h << 4 | v, min(k, 1)]) for k, (h, v) in enumerate(sampling)))
    for t in range(2):
        out += segment(0xC4, bytes([t]) + dc_spec) + segment(0xC4, bytes([0x10 | t]) + ac_spec)
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    h_max, v_max = max(h for h, _ in sampling), max(v for _, v in sampling)
    first = {}

    def number(value):
        size = abs(value).bit_length()
        return size, value if value > 0 else value + (1 << size) - 1

    def scan(components, mcus, blocks_of):
        nonlocal out
        out += segment(0xDA, bytes([len(components)]) + b"".join(bytes([9 - c, min(c, 1) * 0x11]) for c in components) + bytes([0, 63, 0]))
        bits, before, marks = "", dict.fromkeys(components, 0), 0

        def flush():
            nonlocal bits, out
            bits += "1" * (-len(bits) % 8)
            out += b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
            bits = ""

        for m in range(mcus):
            if restart and m and m % restart == 0:
                flush()
                out += bytes([0xFF, 0xD0 + marks % 8])
                marks, before = marks + 1, dict.fromkeys(components, 0)
            for c, spot in blocks_of(m):
                dc = rng.randint(-1000, 1000) // step
                if c == 0:
                    first[spot] = dc
                size, extra = number(dc - before[c])
                before[c] = dc
                code, n = dc_codes[size]
                bits += f"{code:0{n}b}" + (f"{extra:0{size}b}" if size else "")
                at = 1
                for end in sorted(rng.sample(ZIGZAG_ENDS, rng.randint(0, 4))):
                    if end < at:
                        continue
                    while end - at > 15:
                        code, n = ac_codes[0xF0]
                        bits += f"{code:0{n}b}"
                        at += 16
                    size, extra = number(rng.choice([-7, -2, 1, 5]))
                    code, n = ac_codes[(end - at) << 4 | size]
                    bits += f"{code:0{n}b}{extra:0{size}b}"
                    at = end + 1
                if at < 64:
                    code, n = ac_codes[0]
                    bits += f"{code:0{n}b}"
        flush()

    if interleaved and len(sampling) > 1:
        across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
        scan(range(len(sampling)), across * down, lambda m: [(c, (m // across * v + y, m % across * h + x)) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)])
    else:
        for c in reversed(range(len(sampling))):
            h, v = sampling[c]
            across, down = -(-(-(-width * h // h_max)) // 8), -(-(-(-height * v // v_max)) // 8)
            scan([c], across * down, lambda m, c=c, across=across: [(c, divmod(m, across))])
    h, v = sampling[0]
    rows, columns = -(-height * v // (8 * v_max)), -(-width * h // (8 * h_max))
    return out + b"\xff\xd9", np.array([[min(255, max(0, (first[y, x] * step + 4) // 8 + 128)) for x in range(columns)] for y in range(rows)], dtype=np.uint8)


@pytest.mark.parametrize("sampling", [((1, 1),), ((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 2), (1, 1))])
def test_media_of_other_makers(sampling):
    import random

    rng = random.Random(str(sampling))
    streams, want = [], []
    for interleaved in (True, False):
        for restart, wide, (w, h) in ((0, False, (40, 24)), (3, True, (33, 17)), (1, False, (8, 8)), (0, True, (7, 90))):
            stream, thumbnail = foreign_jpeg(rng, w, h, sampling, interleaved, restart, wide)
            streams.append(stream)
            want.append((w, h, thumbnail))
    for got, (w, h, thumbnail) in zip(jpeg.decode_thumbnails(streams), want, strict=True):
        assert got is not None and len(got) == 1 and got[0][:2] == (w, h)
        assert got[0][2].tolist() == thumbnail.tolist()


def test_media_dimensions(spark):
    import random

    stream, thumbnail = foreign_jpeg(random.Random(1), 1533, 5, ((1, 1),))
    row = jpeg.describe(spark.createDataFrame([(1, stream, "mine")], "doc_id long, media binary, width string")).first()
    assert (row.width, row.height, len(row.thumbnail)) == (1533, 5, 192) and bytes(row.thumbnail) == thumbnail.tobytes()


def test_media_that_is_broken(spark):
    good = jpeg.encode_payloads([bytes(range(192))])[0]
    media = [b"", b"\xff\xd8", b"text", good[:-30], good[:40], good, None]
    rows = jpeg.describe(spark.createDataFrame([(k, m) for k, m in enumerate(media)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r.width is None for r in rows] == [True, True, True, True, True, False, True]
    small, wide = jpeg.hashes(np.arange(64, dtype=np.uint8).reshape(8, 8))
    assert wide and small


def best_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    fits = [(len(h) + len(p), len(h), h, p, v) for h, p, k, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[-1] if fits else None


def test_urls_of_a_long_list(spark):
    """A list of 100,000 entries against a plain dictionary, over long URLs and ones that many pages share."""
    rules = [(f"h{k % 5000}.site{k % 97}.org", f"/p{k}/", "list", "block") for k in range(100_000)] + [("org", "/", "rule", "allow")]
    urls = [f"http://sub.h{k % 5000}.site{k % 97}.org/p{k if k % 2 else k + 1}/x/{k}" for k in range(0, 100_000, 331)]
    urls += ["http://a.org" + "/" * 8000, "http://" + "a." * 3000 + "org/", "http://h1.site1.org/p1/" + "s/" * 5000] + ["http://h1.site1.org/p1/"] * 50
    listed = spark.createDataFrame(rules, "host string, path string, kind string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    known = {(h, p) for h, p, kind, _ in rules if kind == "list"}

    def want(url):
        host, path, _ = best_rule(url, [])
        own = [(host[i:], p) for i in [0, *(j + 1 for j, c in enumerate(host) if c == ".")][:3] for p in {path[: j + 1] for j, c in enumerate(path[:20]) if c == "/"}]
        return host, path, "allow" if host.endswith(".org") else "block" if known & set(own) else None

    for hot_rows in (1 << 20, 10):
        rows = url_filters.match(pages, listed, hot_rows=hot_rows).orderBy("page_id").collect()
        assert [(r.host, r.path, r.verdict) for r in rows] == [want(u) for u in urls]
    without = url_filters.match(pages, listed.filter("kind = 'list'")).orderBy("page_id").collect()
    blocked = [bool(known & {(".".join(r.host.split(".")[-3:]), "/" + r.path.split("/")[1] + "/")}) if len(r.host) < 99 and "/p" in r.path else False for r in without]
    assert [r.verdict == "block" for r in without] == blocked and any(blocked) and not all(blocked)


def test_urls_in_canonical_form(spark):
    listed = spark.createDataFrame([("bad.example", "/x/", "list", "block"), ("bad.example", "/y/", "rule", "allow"), ("Up.Example.", "", "list", "block"), (None, "/", "list", "block")], "host string, path string, kind string, verdict string")
    urls = ["http://bad.example/x/1", "http://b%61d.example:80/a/../x/", "http://me:pw@bad.example./%78/./q", "http://bad.example/x", "http://bad.example/%2fx/", "http://bad.example:80/y/", "http://bad.example/y/", "http://a.up.example", "http://bad.example/x/../y"]
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, host int, e int")
    got = [r.verdict for r in url_filters.match(pages, listed).orderBy("page_id").collect()]
    assert got == ["block", "block", "block", None, None, None, "allow", "block", None]


def test_urls_equal_brute_force(spark):
    rules = [("com", "/", "rule", "allow"), ("example.com", "/en/", "rule", "block"), ("www.example.com", "/en/", "rule", "allow"), ("net", "/es/", "rule", "block"), ("b.net", "/es/x", "rule", "allow")]
    urls = [None, "", "nothing", "http://", "http://Example.com/en/1", "https://www.example.com/en/?q", "http://a.b.NET/es/xyz#f", "http://net/es/", "http://anet/es/", "x://example.com", "http://example.com/en", "http://a.com/\nen/", "http://..com//en/", "http://example.com/en/1"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    listed = spark.createDataFrame(rules, "host string, path string, kind string, verdict string")
    for bytes_ in (1 << 20, 64):
        rows = url_filters.match(pages, listed, max_bytes=bytes_).orderBy("page_id").collect()
        assert [(r.host, r.path, r.verdict) for r in rows] == [best_rule(u, rules) for u in urls]
    assert url_filters.match(pages, listed.limit(0)).filter("verdict IS NOT NULL").count() == 0
    assert url_filters.match(pages.limit(0), listed).count() == 0


def test_perspectives(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "system", "note"), (1, 70, "ann", "late"), (2, None, None, "alone"), (3, 0, "system", "only"), (None, 1, "x", "y"), (1, 0, "ann", "hi")]
    frame_ = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({"speaker": F.lit(1), "part": F.lit("x"), "pieces": F.lit(None)})
    got = defaultdict(list)
    for r in chat_format.rotate_whole(frame_).collect():
        got[r.conv_id].append((r.part, r.perspective))
        trained = "".join(r.text[m.start : m.start + m.length] for m in r["mask"] if m.train)
        assert r.text.count("<|im_start|>") == r.n_turns == len(r["mask"])
        assert trained.count("<|im_end|>") == r.n_trained
        assert "<|im_start|>" not in trained
    assert sorted(got[1]) == [(0, "ann"), (0, "bob")]
    assert got[2] == [(0, "unknown")] and 3 not in got and got[None] == [(0, "x")]


def whole_chats(turns):
    """Text and mask of every perspective of every conversation, in plain Python."""
    talks = defaultdict(list)
    for conv, turn, speaker, text in turns:
        talks[conv].append((turn is not None, turn or 0, speaker or "unknown", text or ""))
    out = {}
    for conv, said in talks.items():
        for perspective in {t[2] for t in said} - {"system"}:
            text, mask = "", []
            for _, _, speaker, body in sorted(said):
                mine = speaker == perspective
                text += "<|im_start|>" + ("assistant" if mine else "system" if speaker == "system" else f"user name={speaker}") + "\n"
                mask.append((len(text), len(body) + len("<|im_end|>\n"), mine))
                text += body + "<|im_end|>\n"
            out[conv, perspective] = text, mask
    return out


def test_perspectives_of_whole_conversations(spark):
    turns = [(1, 0, "system", "rules"), *((1, k, ("ann", "bob")[k % 2], f"t{k}") for k in range(1, 700)), (1, None, None, None), (2, 3, "x", "\u00e9\U0001f600"), (3, 0, "system", "only")]
    turns += [(None, k // 50, ("ann", "system", "eve")[k % 3], "same") for k in range(400)] + [(4, 1, "a", "hi")] * 300
    frame_ = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    want = whole_chats(turns)
    for bound in (1 << 20, 9000):
        got = defaultdict(list)
        for r in chat_format.rotate_whole(frame_, whole_bytes=bound).collect():
            assert r.n_turns == len(r["mask"]) and r.n_trained == sum(m.train for m in r["mask"]) and r.split == 0
            got[r.conv_id, r.perspective].append((r.part, r.text, [tuple(m) for m in r["mask"]]))
        for rows in got.values():
            rows.sort()
            assert [r[0] for r in rows] == list(range(len(rows)))
        assert {k: ("".join(r[1] for r in rows), [m for r in rows for m in r[2]]) for k, rows in got.items()} == want
        assert (len(got[1, "ann"]) > 1) == (len(got[4, "a"]) > 1) == (bound == 9000)
    assert chat_format.rotate_whole(frame_.limit(0)).count() == 0


def test_hmac_is_the_standard_one(spark):
    import hmac

    got = spark.range(1).select(pii.Hmac(b"key")(F.lit("text")).alias("h")).first().h
    assert got == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()
