import base64

from hitmerge import fixed_values as fv
from hitmerge.functions import urls
from hitmerge.plans.queries import QUERIES


def test_norm_url(apply):
    cases = [
        # scheme, host, port, user, fragment
        ("HTTP://Shop.Kiln.test:80/Mug", "shop.kiln.test/Mug"), ("https://kiln.test:443/mug/#glaze", "kiln.test/mug"),
        ("http://kiln.test:443/mug", "kiln.test:443/mug"), ("https://kiln.test:8443/mug", "kiln.test:8443/mug"),
        ("https://ann:pw@KILN.test/mug", "kiln.test/mug"), ("//kiln.test/mug", "kiln.test/mug"), ("\thttps://kiln.test/mug ", "kiln.test/mug"),
        # path
        ("https://kiln.test", "kiln.test/"), ("https://kiln.test///", "kiln.test/"), ("https://kiln.test/mug//", "kiln.test/mug"),
        ("https://kiln.test/blue%2fred", "kiln.test/blue%2Fred"), ("https://kiln.test/蓝釉", "kiln.test/%E8%93%9D%E9%87%89"),
        ("https://kiln.test/%e8%93%9d釉", "kiln.test/%E8%93%9D%E9%87%89"), ("https://kiln.test/blue mug", "kiln.test/blue%20mug"),
        # query
        ("https://kiln.test/s?size=9&colour=red", "kiln.test/s?colour=red&size=9"), ("https://kiln.test/s?&&sale", "kiln.test/s?sale="),
        ("https://kiln.test/s?t=old+blue", "kiln.test/s?t=old+blue"), ("https://kiln.test/s?t=old%20blue", "kiln.test/s?t=old+blue"),
        ("https://kiln.test/s?gclid=8&GBRAID=7&p=~*", "kiln.test/s?p=~%2A"), ("https://kiln.test/s?t=%q1", "kiln.test/s?t=%25q1"),
        ("https://kiln.test/s?t=%b0%a1", "kiln.test/s?t=%B0%A1"), ("https://kiln.test/s?b=2&b=1", "kiln.test/s?b=1&b=2"),
        # not an address
        ("", ""), ("Kiln.test/Mug", "kiln.test/mug"), ("HTTP://kiln.test:x1/", "http://kiln.test:x1/"), ("https://kiln.test/%q1", "https://kiln.test/%q1"),
    ]
    assert apply(urls.norm_url, [i for i, _ in cases]) == [w for _, w in cases]


def test_tracking_modes(apply):
    url = ["https://x.com/a?spm=abc&utm_id=1&srsltid=9"]
    assert apply(lambda c: urls.norm_url(c, "default"), url) == ["x.com/a"]
    assert apply(lambda c: urls.norm_url(c, "minimal"), url) == ["x.com/a?spm=abc"]
    assert apply(lambda c: urls.norm_url(c, "none"), url) == ["x.com/a?spm=abc&srsltid=9&utm_id=1"]
    assert len(urls.tracking_keys("minimal")) == 26 and len(urls.tracking_keys("default")) == 32


def test_site(apply):
    cases = [("blue.mug.kiln.test", "kiln.test"), ("kiln.test", "kiln.test"), ("mug.kiln.com.au", "kiln.com.au"), ("com.au", "com.au"),
             ("172.16.4.9", "172.16.4.9"), ("kiln", "kiln"), ("", ""), (".kiln.or.jp.", "kiln.or.jp")]
    assert apply(urls.registrable_site, [i for i, _ in cases]) == [w for _, w in cases]


def test_probe_target(apply):
    cases = [("https://kiln.test/mug?x=1", ("kiln.test", "443")), ("http://kiln.test", ("kiln.test", "80")),
             ("http://kiln.test:9000/mug", ("kiln.test", "9000")), ("https://kiln.test:80/", ("kiln.test", "80")),
             ("http://kiln.test:9o/mug", None), ("mug and bowl", None), ("", None)]
    got = apply(urls.probe_target, [i for i, _ in cases])
    assert [tuple(g) if g else None for g in got] == [w for _, w in cases]


def test_head_and_keys(apply):
    assert apply(urls.head_segment, ["https://a.com//x/y", "https://a.com/", "https://a.com/%E7%8C%AB/1", "zz"]) == \
        ["x", "", "猫", ""]
    assert apply(urls.query_keys, ["https://a.com/?B=1&a=2&&c", "https://a.com/"]) == ["a&b&c", ""]


def test_redirect(apply):
    target = "https://example.com/a"
    wrapped = "https://www.bing.com/ck/a?!&p=1&u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9h&ntb=1"
    bad = "https://www.bing.com/ck/a?u=a1!!!"
    assert apply(urls.unwrap_redirect, [wrapped, bad, target]) == [target, bad, target]


def test_redirect_with_escaped_line_breaks(apply):
    target = "https://www.kiln.test/wares/" + "mug" * 20
    code = base64.encodebytes(target.encode()).decode().rstrip("\n=").replace("\n", "%0D%0A")
    assert "%0D%0A" in code
    wrapped = f"https://www.bing.com/ck/a?!&u=a1{code}&ntb=1"
    raw = wrapped.replace("%0D%0A", "\r\n")             # no address
    assert apply(urls.unwrap_redirect, [wrapped, raw]) == [target, raw]


def test_redirect_query_wraps_long_addresses(spark, tmp_path):
    long = "https://www.kiln.test/wares/" + "mug" * 40
    rows = [(i, long, "") for i in range(3)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["target"] for r in QUERIES["redirect_unwrap"](spark, str(tmp_path)).collect()}
    assert got == {0: long, 1: long, 2: "https://www.bing.com/ck/a?!&p=7&u=a1*2&ntb=1"}


# One address for each rule, made from the rule.
MEDIA = [f"https://m.quark.cn/vsearch/{x}?word=mug" for x in ("", "clips")] \
    + [f"https://m.quark.cn/s?word=mug&qtab={tab}" for tab in fv.MEDIA_TABS] \
    + [f"https://page.sm.cn/kiln/{word}9/show?word=mug" for word in fv.MEDIA_PATH_WORDS] \
    + [f"https://page.sm.cn/kiln/show?h={host}" for host in fv.MEDIA_SOURCE_HOSTS] \
    + ["https://p.quark.cn/kiln/char", "https://p.quark.cn/kiln/word?x=1", "https://p.quark.cn/kiln/show?entity=mug"]
KEEP = [f"https://{host}/mug?qtab=video&h=youku.com&entity=mug" for host in ("kiln.test", "notquark.cn", "quark.cn.kiln.test")] + [
    "https://m.quark.cn/s?word=mug", "https://m.quark.cn/s?word=mug&qtab=news", "https://page.sm.cn/kiln/show?h=kiln.test",
    "https://p.quark.cn/kiln/wordy?x=1", "https://www.iqiyi.com/mug", "https://doc.quark.cn/mug?id=4"]


def test_url_class(apply):
    assert set(apply(urls.url_class, MEDIA)) == {"media"}
    assert not {"media", "transit"} & set(apply(urls.url_class, KEEP))
    assert apply(urls.url_class, ["https://m.quark.cn/s/mug", "https://kiln.test/s/mug", "https://kiln.ucweb.com/x", "mug:"]) == \
        ["transit", "external", "shell", "shell"]


def test_shell_cleaning(apply):
    every = "&".join(f"{k}=1" for k in fv.SHELL_TRACKING)
    cases = [
        (f"https://kiln.test/mug?{every}", f"https://kiln.test/mug?{every}"), (f"https://doc.sm.cn/mug?{every}", "https://doc.sm.cn/mug"),
        (f"https://uc.cn/mug?id=4&{every}&title=old%20blue", "https://uc.cn/mug?id=4&title=old%20blue"),
        ("https://quark.cn/mug?bucket=2#glaze", "https://quark.cn/mug#glaze"), ("/mug?entry=2&size=9", "/mug?size=9"),
        ("https://quark.cn/mug?sidecar=2", "https://quark.cn/mug?sidecar=2"),
    ]
    assert apply(urls.clean_shell_url, [i for i, _ in cases]) == [w for _, w in cases]
