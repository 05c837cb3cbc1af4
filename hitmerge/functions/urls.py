"""URL columns: canonical form, parts, site, redirect unwrapping, shell cleaning, classes.

URLs are split by regexp: the ``parse_url`` family rejects raw spaces, ``|`` and non-ASCII
characters that real result lists contain. Percent escapes are rewritten byte by byte and
never decoded to text for comparison, so escapes of legacy encodings stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.columns import let, trim_white

# ---- splitting -----------------------------------------------------------------------------
_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//"
    r"(?:([A-Za-z0-9\-._~!$&'()*+,;=:%@]*)@)?"
    r"(\[[^\]/?#@]*\]|[^/?#@:\[\]]*)(?::([0-9]*))?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"
)
_MARK = "\u0001"
_ORDER = _MARK.join(["$1", "$3", "$4", "$5", "$6", "$2", "$7"])
SCHEME, HOST, PORT, PATH, QUERY, USER, FRAGMENT = range(7)

_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_GOOD_HOST = (
    r"^(\[.*\]|(?:[A-Za-z0-9\-_.~!$&'()*+,;=<>\"]|[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f])+)$"
)
_PLAIN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
_CANONICAL_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@]*$"
_PLAIN_VALUE = r"^[A-Za-z0-9\-_.~]*$"
_UNRESERVED_HEX = "3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D|2E|5F|7E"
_PATH_HEX = _UNRESERVED_HEX + "|24|26|2B|2C|2F|3A|3B|3D|40"


def url_fields(url: Column) -> Column:
    """array(scheme, host, port, path, query, userinfo, fragment); NULL without a usable host."""
    clean = F.when(~url.rlike(r"[\x00-\x1F\x7F]"), url)
    pieces = F.split(F.regexp_replace(clean, _SPLIT, _ORDER), _MARK, -1)

    def check(a: Column) -> Column:
        checked = F.concat_ws(
            " ", F.get(a, F.lit(USER)), F.get(a, F.lit(HOST)), F.get(a, F.lit(PATH)),
            F.get(a, F.lit(FRAGMENT)),
        )
        return F.when(
            (F.size(a) == 7) & F.get(a, F.lit(HOST)).rlike(_GOOD_HOST)
            & ~checked.rlike(_BAD_ESCAPE), a,
        )

    return let(pieces, check)


def _f(fields: Column, i: int) -> Column:
    return F.get(fields, F.lit(i))


def _raw_host(fields: Column) -> Column:
    h = F.regexp_replace(_f(fields, HOST), r"^\[|\]$", "")
    return F.when(F.contains(h, F.lit("%")), F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B")))) \
        .otherwise(h)


def _host(fields: Column) -> Column:
    return F.lower(_raw_host(fields))


# ---- percent escapes -----------------------------------------------------------------------
def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _encode_path_text(c: Column) -> Column:
    return _replace_all(F.url_encode(c), [
        ("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"),
        ("%2C", ","), ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
    ])


def _encode_value_text(c: Column) -> Column:
    return _replace_all(F.url_encode(c), [("*", "%2A"), ("%7E", "~")])


def _rewrite_escapes(c: Column, text, keep_hex: str, space: str) -> Column:
    """Canonical spelling of a validly escaped string; ``text`` encodes the stretches between
    escapes, ``keep_hex`` lists the escapes that are spelled as the plain character."""

    def piece(t: Column, i: Column) -> Column:
        hex2 = F.upper(F.substring(t, 1, 2))
        spelled = (
            F.when(hex2.rlike(f"^({keep_hex})$"), F.char(F.conv(hex2, 16, 10).cast("bigint")))
            .when(hex2 == "20", F.lit(space))
            .otherwise(F.concat(F.lit("%"), hex2))
        )
        return F.when(i == 0, text(t)).otherwise(
            F.concat(spelled, text(F.substr(t, F.lit(3)))))

    return F.array_join(F.transform(F.split(c, "%", -1), piece), "")


def _upper_escapes(c: Column) -> Column:
    upper = F.array_join(
        F.transform(F.split(c, "%", -1), lambda t, i: F.when(i == 0, t).otherwise(
            F.concat(F.upper(F.substring(t, 1, 2)), F.substr(t, F.lit(3))))), "%")
    return F.when(F.contains(c, F.lit("%")), upper).otherwise(c)


def _decoded_path_key(path: Column) -> Column:
    """Two paths get the same key exactly when their decoded bytes are equal."""
    return F.when(path.rlike(_CANONICAL_PATH), path).otherwise(
        _rewrite_escapes(path, _encode_path_text, _PATH_HEX, "%20"))


def _escaped_path(path: Column) -> Column:
    """Existing escapes stay (so an escaped slash never becomes a real one) unless the path
    holds characters that have to be escaped, which re-encodes the whole decoded path."""
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(_decoded_path_key(path))


def _decode(c: Column) -> Column:
    return F.when(c.rlike("[%+]") & ~c.rlike(_BAD_ESCAPE), F.try_url_decode(c)).otherwise(c)


def _encoded(c: Column) -> Column:
    literal = _encode_value_text(c)
    canonical = _rewrite_escapes(
        c, lambda t: _encode_value_text(F.replace(t, F.lit("+"), F.lit(" "))), _UNRESERVED_HEX, "+")
    return F.when(c.rlike(_PLAIN_VALUE), c).when(c.rlike(_BAD_ESCAPE), literal).otherwise(canonical)


def _pairs(query: Column) -> Column:
    """Query pieces as array of (key, value), still escaped."""
    kept = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(kept, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("k"),
        F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("").alias("v"),
    ))


def query_value(query: Column, name: str) -> Column:
    """Decoded value of the first pair with this key, '' when absent."""
    named = F.filter(_pairs(query), lambda p: _decode(p["k"]) == name)
    return F.coalesce(_decode(F.get(named, F.lit(0))["v"]), F.lit(""))


# ---- tracking parameters and the canonical form --------------------------------------------
def tracking_keys(mode: str) -> list[str]:
    """Query keys that do not decide which page it is: modes default, minimal, none."""
    if mode == "none":
        return []
    if mode == "minimal":
        return list(fv.TRACKING_MINIMAL)
    if mode == "default":
        return fv.TRACKING_MINIMAL + fv.TRACKING_EXTRA
    raise ValueError(f"unknown tracking mode {mode!r}")


def is_tracking(key: Column, mode: str = "default") -> Column:
    keys = tracking_keys(mode)
    return F.lower(key).isin(keys) if keys else F.lit(False)


def norm_query(query: Column, mode: str = "default") -> Column:
    pairs = F.transform(_pairs(query), lambda p: F.struct(
        _decode(p["k"]).alias("dk"), _decode(p["v"]).alias("dv"),
        _encoded(p["k"]).alias("k"), _encoded(p["v"]).alias("v")))
    kept = F.filter(pairs, lambda p: ~is_tracking(p["dk"], mode)) if mode != "none" else pairs
    joined = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(query == "", "").otherwise(joined)


def _norm_from_fields(raw: Column, fields: Column, mode: str) -> Column:
    scheme, port = F.lower(_f(fields, SCHEME)), _f(fields, PORT)
    implied = (port == "") | ((scheme == "http") & (port == "80")) | \
        ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(_upper_escapes(_escaped_path(_f(fields, PATH))), "/+$", "")
    base = F.concat(
        _host(fields), F.when(implied, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path))
    full = let(norm_query(_f(fields, QUERY), mode),
               lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))
    return F.when(raw == "", "").when(fields.isNull(), F.lower(raw)).otherwise(full)


def norm_url(url: Column, mode: str = "default") -> Column:
    """Canonical page address: no scheme, fragment, userinfo, implied port, trailing slashes or
    tracking parameters; the query sorted; strings without a host only lower-cased."""
    return let(trim_white(url), lambda raw: let(
        url_fields(raw), lambda f: _norm_from_fields(raw, f, mode)))


# ---- host-level columns --------------------------------------------------------------------
def host_of(url: Column) -> Column:
    return F.coalesce(let(url_fields(trim_white(url)), _host), F.lit(""))


def registrable_site(host: Column) -> Column:
    def site(h: Column) -> Column:
        labels = F.split(h, r"\.")
        two = F.array_join(F.slice(labels, -2, 2), ".")
        return (
            F.when((h == "") | ~F.contains(h, F.lit(".")) | h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), h)
            .when((F.size(labels) >= 3) & two.isin(fv.TWO_LEVEL_SUFFIXES),
                  F.array_join(F.slice(labels, -3, 3), "."))
            .otherwise(two))

    return let(F.lower(F.regexp_replace(host, r"^\.+|\.+$", "")), site)


def _head_key(path: Column) -> Column:
    return F.coalesce(
        F.get(F.filter(F.split(_decoded_path_key(path), "/"), lambda s: s != ""), F.lit(0)), F.lit(""))


def head_segment(url: Column) -> Column:
    """First non-empty segment of the decoded path."""
    key = let(url_fields(trim_white(url)), lambda f: _head_key(_f(f, PATH)))
    return F.coalesce(_decode(F.replace(key, F.lit("+"), F.lit("%2B"))), F.lit(""))


def query_keys(url: Column) -> Column:
    """Sorted lower-case query keys as written, joined by &."""
    q = let(url_fields(trim_white(url)), lambda f: _f(f, QUERY))
    return F.coalesce(F.array_join(
        F.array_sort(F.transform(_pairs(q), lambda p: F.lower(p["k"]))), "&"), F.lit(""))


def probe_target(url: Column) -> Column:
    """struct(host, port) to test for reachability; NULL when the URL gives none."""
    def target(f: Column) -> Column:
        port = _f(f, PORT)
        by_scheme = F.when(F.lower(_f(f, SCHEME)) == "https", "443").otherwise("80")
        return F.when(f.isNotNull() & (F.length(port) <= 18), F.struct(
            _raw_host(f).alias("host"), F.when(port == "", by_scheme).otherwise(port).alias("port")))

    return let(url_fields(url), target)


def with_url_columns(df: DataFrame, url: str = "url", mode: str = "default",
                     prefix: str = "") -> DataFrame:
    """Add norm_url, host, site and head_key, splitting each URL once."""
    raw, fields = "__raw_url", "__url_fields"
    c = F.col(fields)
    return (
        df.withColumn(raw, trim_white(F.col(url)))
        .withColumn(fields, url_fields(F.col(raw)))
        .withColumns({
            prefix + "norm_url": _norm_from_fields(F.col(raw), c, mode),
            prefix + "host": F.coalesce(_host(c), F.lit("")),
            prefix + "head_key": F.when(c.isNull(), "").otherwise(_head_key(_f(c, PATH))),
        })
        .withColumn(prefix + "site", registrable_site(F.col(prefix + "host")))
        .drop(raw, fields)
    )


# ---- redirects and shell pages -------------------------------------------------------------
def unwrap_redirect(url: Column) -> Column:
    """Target of a click-through URL that carries it base64-coded in ``u``; else unchanged."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def decoded(payload: Column) -> Column:
        body = F.regexp_replace(payload, "^a1", "")
        pad = F.when(F.length(body) % 4 != 0, F.repeat(F.lit("="), 4 - F.length(body) % 4)).otherwise("")
        mixed = body.rlike("[-_]") & body.rlike("[+/]")
        return F.when(~mixed & body.rlike("^[A-Za-z0-9+/_=-]+$"),
                      F.try_to_binary(F.concat(F.translate(body, "-_", "+/"), pad), F.lit("base64"))
                      .cast("string"))

    # Line breaks inside the code count for nothing if the address escapes them; bare ones make it no address.
    target = let(F.translate(query_value(query, "u"), "\r\n", ""), decoded)
    return F.when(F.contains(url, F.lit("/ck/a")) & ~url.rlike("[\\x00-\\x1F\\x7F]"), let(target, lambda t: F.when(
        t.rlike("^https?://"), t).otherwise(url))).otherwise(url)


def _is_shell_host(host: Column) -> Column:
    own = host.isin(fv.SHELL_HOSTS)
    for suffix in fv.SHELL_SUFFIXES:
        own = own | F.endswith(host, F.lit(suffix))
    return own


def _strip_shell_query(query: Column) -> Column:
    return F.array_join(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(
        F.substring_index(p, "=", 1)).isin(fv.SHELL_TRACKING)), "&")


def clean_shell_url(url: Column) -> Column:
    """Drop session and experiment keys on the engine's own hosts, order and spelling of the rest
    kept; URLs of other sites stay byte-identical."""
    def rebuilt(f: Column) -> Column:
        user, port, fragment = _f(f, USER), _f(f, PORT), _f(f, FRAGMENT)
        kept = _strip_shell_query(_f(f, QUERY))
        return F.concat(
            F.when(_f(f, SCHEME) == "", "").otherwise(F.concat(F.lower(_f(f, SCHEME)), F.lit(":"))),
            F.lit("//"), F.when(user == "", "").otherwise(F.concat(user, F.lit("@"))),
            _f(f, HOST), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
            _escaped_path(_f(f, PATH)),
            F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
            F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)))

    # A relative address counts as the engine's own page.
    relative = r"^([^:?#%\x00-\x20]*)\?([^#]*)(#.*)?$"
    rel_query = _strip_shell_query(F.regexp_extract(url, relative, 2))
    rel = F.concat(F.regexp_extract(url, relative, 1),
                   F.when(rel_query == "", "").otherwise(F.concat(F.lit("?"), rel_query)),
                   F.regexp_extract(url, relative, 3))
    return let(url_fields(url), lambda f: (
        F.when(f.isNull(), F.when(url.rlike(relative), rel).otherwise(url))
        .when(~_is_shell_host(_host(f)) | (_f(f, QUERY) == ""), url)
        .otherwise(rebuilt(f))))


def url_class(url: Column) -> Column:
    """external / shell / media / transit. Unknown pages on own hosts stay ``shell``."""
    def by_fields(f: Column) -> Column:
        host, query = _host(f), _f(f, QUERY)
        path = F.coalesce(_decode(F.replace(_f(f, PATH), F.lit("+"), F.lit("%2B"))), F.lit(""))
        lpath = F.lower(path)
        h = F.lower(query_value(query, "h"))
        page_word, video_source = F.lit(False), F.lit(False)
        for word in fv.MEDIA_PATH_WORDS:
            page_word = page_word | F.contains(lpath, F.lit(word))
        for source in fv.MEDIA_SOURCE_HOSTS:
            video_source = video_source | F.contains(h, F.lit(source))
        media = (
            F.when(host == "m.quark.cn", F.startswith(lpath, F.lit("/vsearch"))
                   | F.lower(query_value(query, "qtab")).isin(fv.MEDIA_TABS))
            .when(host == "page.sm.cn", page_word | video_source)
            .when(host == "p.quark.cn", F.regexp_replace(lpath, "^/+|/+$", "").rlike("(^|/)(char|word)$")
                  | (query_value(query, "entity") != ""))
            .otherwise(False))
        return (
            F.when(media, "media")
            .when((host == "m.quark.cn") & F.startswith(path, F.lit("/s/")), "transit")
            .when(_is_shell_host(host), "shell").otherwise("external"))

    return let(url_fields(url), lambda f: F.when(f.isNull(), "shell").otherwise(by_fields(f)))
