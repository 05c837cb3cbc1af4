
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions import terms, text
from hitmerge.functions.columns import WHITE_TEXT, first_non_blank, squeeze_white


def test_norm_text_drops_unicode_space(apply):
    spaced = [f"blue{chr(c)}MUG" for c in (0x09, 0x20, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x1C, 0x1F)]
    assert set(apply(text.norm_text, spaced)) == {"bluemug"}
    assert apply(text.norm_text, [f"a{c}b" for c in fv.TEXT_NOISE]) == ["ab"] * len(fv.TEXT_NOISE)
    assert apply(text.norm_text, ["1.5/2=a&b%", "甲．乙｜丙"]) == ["1.5/2=a&b%", "甲．乙｜丙"]


def test_white_space_runs_become_one_space(apply):
    runs = [f"{w}{w}one{w}two \n{w}three{w}" for w in WHITE_TEXT]
    assert apply(squeeze_white, runs) == ["one two three"] * len(runs)
    assert apply(squeeze_white, ["", " \u3000\n", "one", "\x1fone\x00 ", None]) == ["", "", "one", "\x1fone\x00", None]


def test_site_suffix(apply):
    cases = [(f"Firing a kiln {sep} Claypots", "Firing a kiln") for sep in fv.TITLE_SEPARATORS] + [
        ("Firing a kiln - How to - Clay", "Firing a kiln"), ("Firing - one - two - three", "Firing - one"),
        ("烧制瓷器 - 陶艺网", "烧制瓷器"), ("Firing a kiln - Claypots, Inc", "Firing a kiln - Claypots, Inc"),
        ("Firing a kiln - Thirteen sign", "Firing a kiln - Thirteen sign"), ("_Claypots", "_Claypots"), ("Firing a kiln -", "Firing a kiln -"),
        ("Firing a kiln", "Firing a kiln"), ("", "")]
    assert apply(text.strip_site_suffix, [i for i, _ in cases]) == [w for _, w in cases]


def test_mojibake(apply):
    wrong = lambda t: t.encode().decode("latin-1")
    whole = ["瓷器", "glaze 釉 blue", "青花「瓷」", "кобальт"]
    assert apply(text.repair_mojibake, [wrong(t) for t in whole]) == whole
    keep = ["cobalt", "", "瓷器", "naïve", wrong("naïve"), wrong("瓷器") + "釉", wrong("瓷器")[:-1], "cobalt \ufffd", "÷"]
    assert apply(text.repair_mojibake, keep) == keep


def test_clean_snippet(apply):
    cases = [("read [the glaze book](https://kiln.test/g) first", "read the glaze book first"), ("mug ![blue](b.png)bowl", "mug bowl"),
             ("\n blue\t\tmug  ", "blue mug"), ("", ""), ("[a](b) and [c](d)", "a and c")]
    assert apply(text.clean_snippet, [i for i, _ in cases]) == [w for _, w in cases]


def test_numbers_cover_fullwidth(apply):
    assert apply(lambda c: text.number_set(c, F.lit("x9")), ["２０２４年 2023 2023"]) == [["２０２４", "2023", "9"]]


def test_shingles(apply):
    assert apply(lambda c: text.shingles(c, 3), ["", "ab", "abc", "abcd", "aaaaa", "紫色面具"]) == \
        [[], ["ab"], ["abc"], ["abc", "bcd"], ["aaa"], ["紫色面", "色面具"]]


def test_similarity(apply):
    got = apply(lambda c: text.text_jaccard(c, F.lit("abcde"), 3), ["abcde", "abcdx", "", "zzz"])
    assert got == [1.0, 0.5, 0.0, 0.0]
    empty = F.array().cast("array<string>")
    assert apply(lambda c: text.number_overlap(empty, empty), ["x"]) == [1.0]


def test_small_helpers(apply, spark):
    assert apply(lambda c: text.truncate_chars(c, 5), ["abcde", "abc def", ""]) == ["abcde", "abc…", ""]
    assert apply(lambda c: text.truncate_chars(c, 0), ["abc"]) == [""]
    assert apply(lambda c: first_non_blank(c, F.lit("z")), ["", " 　", " a", None]) == ["z", "z", " a", "z"]
    m = F.create_map(F.lit("exa"), F.lit(3), F.lit("bing"), F.lit(1))
    assert apply(lambda c: text.positions_text(m), ["x"]) == ["(bing#1, exa#3)"]
    assert [tuple(x) for x in apply(text.query_locale, ["go 语言", "go"])] == [("cn", "zh-cn"), ("us", "en")]
    assert apply(text.card_type, ['{"sc": " ss_pic "}', '{"sc": 3}', "{", ""]) == ["ss_pic", "", "", ""]


def test_terms(apply):
    def get(q):
        t = apply(terms.query_terms, [q])[0]
        return list(t["anchor"]), list(t["rest"])

    assert get("kiln firing glazes cracked") == (["kiln"], ["firing", "glaz", "crack"])
    assert get("filetype:pdf kilns before:2020 glass") == (["kiln"], ["glass"])
    assert get("青花瓷器修复") == (["青花"], ["瓷器", "器修", "修复"])
    assert get("青花瓷 修复") == (["青花", "花瓷"], ["修复"])
    assert get("kiln kilnwash shelf") == (["kiln"], ["shelf"])
    assert get('the -"old blue" kiln -mug OR v1.2 shelf shelves shelf') == (["kiln"], ["v1.2", "shelf", "shelv"])
    assert get("kiln") == (["kiln"], [])


def test_rest_pattern_boundaries(apply):
    pattern = apply(lambda c: terms.rest_pattern(terms.query_terms(c)["rest"]), ["vietnam gdp go"])[0]
    hit = lambda t: apply(lambda c: F.regexp_like(c, F.lit(pattern)), [t])[0]
    assert hit("gdp grew") and hit("学go语言") and not hit("gdpq grew") and not hit("google")
