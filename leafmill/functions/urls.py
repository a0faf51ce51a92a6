"""Web addresses: extraction, parts, and rules that flag tricks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.spans import let, regex_spans

# Patterns, endings, services and brands.
IN_TEXT = r"(?i)\b(?:https?://|www\.)[^\s<>\"'`]+"
TRAILING = r"[.,;:!?)\]}'\"]+$"
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at tiny.cc s.id rb.gy t.ly lnkd.in qrco.de qr.net bl.ink short.io v.gd clck.ru u.to shorte.st adf.ly tr.im x.co soo.gd bitly.com trib.al db.tt".split()
TWO_LEVEL = "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.in net.in org.in gov.in com.br net.br org.br gov.br com.mx com.ar com.co com.pe com.tr com.cn net.cn org.cn gov.cn com.hk com.tw com.sg com.my com.ph com.vn com.pk com.sa com.eg co.za co.il co.kr or.kr com.ng co.ke com.ua co.id com.bd com.np github.io gitlab.io pages.dev vercel.app netlify.app herokuapp.com web.app firebaseapp.com azurewebsites.net blogspot.com wordpress.com wixsite.com weebly.com glitch.me".split()
BRANDS = {
    "paypal": "paypal.com paypal.me paypalobjects.com",
    "apple": "apple.com icloud.com apple.co",
    "icloud": "icloud.com apple.com",
    "microsoft": "microsoft.com live.com office.com outlook.com microsoftonline.com sharepoint.com onedrive.com msn.com azure.com office365.com windows.net",
    "office365": "office.com office365.com microsoft.com",
    "outlook": "outlook.com live.com office.com microsoft.com",
    "google": "google.com gmail.com youtube.com googleusercontent.com goo.gl g.co google.co.uk",
    "gmail": "gmail.com google.com",
    "amazon": "amazon.com amazon.co.uk amazon.de amazon.fr amazon.in amazon.ca amazon.co.jp amazon.es amazon.it amazon.ae amazon.sa amzn.to aws.amazon.com amazonaws.com",
    "netflix": "netflix.com",
    "facebook": "facebook.com fb.com fb.me meta.com",
    "instagram": "instagram.com",
    "whatsapp": "whatsapp.com wa.me whatsapp.net",
    "linkedin": "linkedin.com lnkd.in",
    "dhl": "dhl.com dhl.de dhl.co.uk",
    "fedex": "fedex.com",
    "usps": "usps.com",
    "royalmail": "royalmail.com",
    "dropbox": "dropbox.com db.tt",
    "docusign": "docusign.com docusign.net",
    "adobe": "adobe.com",
    "chase": "chase.com",
    "wellsfargo": "wellsfargo.com",
    "bankofamerica": "bankofamerica.com",
    "hsbc": "hsbc.com hsbc.co.uk",
    "barclays": "barclays.co.uk barclays.com",
    "coinbase": "coinbase.com",
    "binance": "binance.com",
    "steam": "steampowered.com steamcommunity.com",
    "steamcommunity": "steamcommunity.com",
    "irs": "irs.gov",
    "hmrc": "gov.uk",
}
FILE_LIKE = ["zip", "mov"]
CHEAP = "top xyz click work rest loan country gq tk ml cf ga icu cyou cam buzz monster sbs lol quest bar".split()
HIDDEN = ["javascript", "data", "vbscript", "file"]
ONWARD = r"(?i)^(url|redirect|redirect_uri|next|target|dest|destination|u|r|continue|return|goto|link)$"
SHOWN = r"(?:https?://)?((?:[\p{L}\p{N}-]+\.)+\p{L}{2,})"
SCRIPTS = ["IsLatin", "IsCyrillic", "IsGreek", "IsArmenian"]
_URL = r"(?is)^([a-z][a-z0-9+.-]*):(?://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^:/?#@]*)(?::(\d*))?)?([^?#]*)(?:\?([^#]*))?"
FLAGS = "array<struct<rule:string,severity:string,detail:string>>"


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def extract_urls(text: Column) -> Column:
    """``value, start, stop`` of addresses in text, without the marks that end a sentence."""

    def trimmed(s: Column) -> Column:
        value = F.regexp_replace(s["value"], TRAILING, "")
        return F.struct(value.alias("value"), s["start"].alias("start"), (s["start"] + F.length(value)).alias("stop"))

    return F.transform(regex_spans(text, IN_TEXT), trimmed)


def normal_url(url: Column) -> Column:
    """One form for ``https://www.Example.com/`` and ``example.com``."""
    for pattern in ("^[a-z]+://", r"^www\.", "/$"):
        url = F.regexp_replace(F.lower(F.trim(url)) if pattern == "^[a-z]+://" else url, pattern, "")
    return url


def url_parts(url: Column) -> Column:
    """``scheme, userinfo, host, port, path, query``; https where there is no scheme; host null where it cannot be read."""
    raw = F.trim(url)
    raw = F.when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda k: F.regexp_extract(raw, _URL, k)
    host = F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(part(3)), part(3)), r"^\[|\]$", ""))
    able = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int").between(0, 65535), F.lit(True))
    good = let(let(host, numeric_host), lambda h: F.when((h != "") & ~h.rlike(r"[\s<>^|%]") & able, h))
    empty = lambda c: F.nullif(c, F.lit(""))
    port = F.nullif(F.regexp_replace(part(4), "^0+(?=.)", ""), F.lit(""))
    return F.struct(F.lower(part(1)).alias("scheme"), empty(part(2)).alias("userinfo"), good.alias("host"), port.alias("port"), part(5).alias("path"), empty(part(6)).alias("query"))


def numeric_host(host: Column) -> Column:
    """A host of one to four numbers, decimal, octal or hexadecimal, as browsers read it: in dotted form; other hosts as they are."""
    number = r"(?:0x[0-9a-f]{0,8}|[0-9]{1,12})"
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    return F.when(host.rlike(rf"^{number}(?:\.{number}){{0,3}}\.?$"), let(F.transform(parts, _number), _dotted)).otherwise(host)


def _number(p: Column) -> Column:
    return F.when(p.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 8)), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p).try_cast("long")


def _dotted(values: Column) -> Column:
    """An address of four bytes from its one to four numbers; null where one is too large."""
    n = F.size(values)
    room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
    fits = F.forall(F.slice(values, 1, n - 1), lambda v: v < 256) & (F.element_at(values, -1) < room)
    whole = F.aggregate(F.slice(values, 1, n - 1), F.struct(F.lit(1 << 24).cast("long").alias("unit"), F.lit(0).cast("long").alias("sum")), lambda a, v: F.struct((a["unit"] / 256).cast("long").alias("unit"), (a["sum"] + v * a["unit"]).alias("sum")))["sum"] + F.element_at(values, -1)
    byte = lambda w, k: F.shiftright(w, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.when(fits, let(whole, lambda w: F.concat_ws(".", byte(w, 24), byte(w, 16), byte(w, 8), byte(w, 0))))


def registrable_domain(host: Column) -> Column:
    """The part of a host that someone registered: two labels, or three where the last two are sold like one."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(F.array_contains(literals(TWO_LEVEL), last(2)), last(3)).otherwise(last(2))


def _brand(host: Column, domain: Column) -> Column:
    """The first brand, in the order given, whose name is in a host that it does not own."""
    brands = F.array(*[F.struct(F.lit(b).alias("name"), literals(o.split()).alias("owned")) for b, o in BRANDS.items()])
    name = F.substring_index(domain, ".", 1)

    def hit(b: Column) -> Column:
        # a label, or a part of one between dashes, is the name; or the registered name holds it
        inside = F.array_contains(F.split(host, "[._-]"), b["name"]) | ((name != b["name"]) & name.contains(b["name"]))
        own = F.exists(b["owned"], lambda d: (domain == d) | F.endswith(host, F.concat(F.lit("."), d)))
        return inside & ~own

    return F.get(F.filter(brands, hit), F.lit(0))["name"]


def _onward(query: Column) -> Column:
    """The host of the first redirect-like value of a query that is a web address."""
    pairs = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    first = F.get(F.filter(pairs, lambda p: p["k"].rlike(ONWARD) & p["v"].rlike("(?i)^https?://")), F.lit(0))
    return let(first["v"], lambda v: url_parts(v)["host"])


def flags_of(c: dict[str, Column], url: Column) -> Column:
    """The flags of an address whose parts are in columns: scheme, userinfo, host, port, ascii, domain, brand, onward,
    onward_domain, seen, seen_domain; ``ascii`` is the host as written, ``host`` as shown."""
    host, scheme = c["host"], c["scheme"]
    labels = F.split(host, r"\.")
    tld = F.element_at(labels, -1)
    scripts = sum((F.when(host.rlike(rf"\p{{{s}}}"), 1).otherwise(0) for s in SCRIPTS), F.lit(0))
    web, hidden = scheme.isin("http", "https"), scheme.isin(HIDDEN)
    good = web & host.isNotNull()

    def flag(when: Column, rule: str, severity: Column | str, detail: Column | None = None) -> Column:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))

    return F.array_compact(
        F.array(
            flag(web & host.isNull(), "invalid", "medium"),
            flag(hidden, "hidden", "high", scheme),
            flag(~web & ~hidden, "scheme", "info", scheme),
            flag(good & (scheme == "http"), "http", "medium"),
            flag(good & c["userinfo"].isNotNull(), "userinfo", "high", host),
            flag(good & (c["ascii"].rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | c["ascii"].contains(":")), "ip", "high"),
            flag(good & c["ascii"].rlike(r"(^|\.)xn--|[^\x00-\x7F]"), "idn", F.when(scripts > 1, "high").otherwise("medium"), host),
            flag(good & (c["domain"].isin(SHORTENERS) | c["ascii"].isin(SHORTENERS)), "shortener", "medium"),
            flag(good & c["brand"].isNotNull(), "brand", "high", c["brand"]),
            flag(good & tld.isin(FILE_LIKE), "file_like", "medium", tld),
            flag(good & tld.isin(CHEAP), "cheap", "info", tld),
            flag(good & c["port"].isNotNull() & ~c["port"].isin("80", "443"), "port", "medium", c["port"]),
            flag(good & (F.size(labels) > 5), "subdomains", "info"),
            flag(good & c["onward"].isNotNull() & (c["onward_domain"] != c["domain"]), "redirect", "medium", c["onward"]),
            flag(good & (F.length(url) > 300), "length", "info"),
            flag(good & (c["seen"] != "") & (c["seen_domain"] != c["domain"]), "shown", "high", c["seen"]),
        )
    )


def with_verdicts(df: DataFrame, url: str, shown: str | None = None, unicode_host: str | None = None) -> DataFrame:
    """``df`` with ``severity, flags, host, domain``, built in steps so that every part is worked out once. No shuffle."""
    keep = [f"`{c}`" for c in df.columns if c not in ("severity", "flags", "host", "domain")]
    df = df.withColumn("_p", url_parts(F.col(url)))
    df = df.withColumn("_host", F.coalesce(F.col(unicode_host), F.col("_p.host")) if unicode_host else F.col("_p.host"))
    seen = F.regexp_extract(F.trim(F.coalesce(F.col(shown), F.lit(""))), SHOWN, 1) if shown else F.lit("")
    df = df.withColumns({"_domain": registrable_domain(F.col("_host")), "_onward": _onward(F.col("_p.query")), "_seen": seen})
    df = df.withColumns({"_brand": _brand(F.col("_host"), F.col("_domain")), "_onward_domain": registrable_domain(F.col("_onward")), "_seen_domain": registrable_domain(F.col("_seen"))})
    # a host that only looks beyond ASCII, as wide letters do, is the ASCII one
    written = F.when(F.col("_p.host").rlike("[^\\x00-\\x7F]") & ~F.col("_host").rlike("[^\\x00-\\x7F]"), F.col("_host")).otherwise(F.col("_p.host"))
    c = {k: F.col(f"_p.{k}") for k in ("scheme", "userinfo", "port")} | {k: F.col(f"_{k}") for k in ("host", "domain", "brand", "onward", "onward_domain", "seen", "seen_domain")}
    df = df.withColumn("_flags", flags_of(c | {"ascii": written}, F.col(url)))
    web = F.col("_p.scheme").isin("http", "https")
    return df.select(*keep, worst_severity(F.col("_flags")).alias("severity"), F.col("_flags").alias("flags"), F.when(web, F.col("_host")).alias("host"), F.when(web, F.col("_domain")).alias("domain"))


def worst_severity(flags: Column) -> Column:
    has = lambda s: F.exists(flags, lambda f: f["severity"] == s)
    return F.when(has("high"), "high").when(has("medium"), "medium").otherwise("info")


def describe_payload(raw: Column, url_severity: Column | str = "info") -> Column:
    """``kind, details, severity`` of the text of a QR code; ``url_severity``: what ``with_verdicts`` says of it as an address."""
    text = F.trim(raw)
    low = F.lower(text)
    rest = lambda at: F.substring(text, F.lit(at), F.length(text))

    def field(body: Column, key: str) -> Column:
        value = F.regexp_extract(body, rf"(?i)(?:^|;){key}:((?:\\.|[^;])*)", 1)
        return F.when(body.rlike(rf"(?i)(?:^|;){key}:"), F.regexp_replace(value, r"\\(.)", "$1"))

    body = rest(6)
    security = F.coalesce(F.nullif(field(body, "T"), F.lit("")), F.lit("none"))
    wifi = F.array_compact(F.array(F.concat(F.lit("network: "), F.coalesce(field(body, "S"), F.lit("?"))), F.concat(F.lit("security: "), security), F.when(F.nullif(field(body, "P"), F.lit("")).isNotNull(), "with password")))
    name = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\nFN:(.*)", 1), F.lit("")), field(rest(8), "N"), F.lit("Contact"))
    lines = F.split(text, r"\r?\n")
    bank = text.rlike(r"^BCD\r?\n")
    paid = F.when(bank, F.array_compact(F.array(F.concat(F.lit("to: "), F.coalesce(F.get(lines, F.lit(5)), F.lit("?"))), F.concat(F.lit("account: "), F.coalesce(F.get(lines, F.lit(6)), F.lit("?"))), F.concat(F.lit("amount: "), F.nullif(F.get(lines, F.lit(7)), F.lit("")))))).otherwise(F.array(F.substring_index(text, "?", 1)))
    code = F.try_url_decode(F.substring_index(F.regexp_replace(text, "(?i)^otpauth://[^/]+/", ""), "?", 1))

    def out(kind: str, details: Column, severity: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), details.cast("array<string>").alias("details"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))

    return (
        F.when(low.rlike(r"^https?://") | low.rlike(r"^www\.[^\s]+\.[a-z]{2,}"), out("url", F.array(text), url_severity))
        .when(low.startswith("wifi:"), out("wifi", wifi, F.when(security.rlike("(?i)^(nopass|none)$"), "medium").otherwise("info")))
        .when(low.startswith("mailto:"), out("email", F.array(F.substring_index(rest(8), "?", 1)), "info"))
        .when(low.startswith("tel:"), out("phone", F.array(rest(5)), "info"))
        .when(low.rlike("^sms(to)?:"), out("sms", F.array(F.regexp_replace(text, "(?i)^smsto?:", "")), "medium"))
        .when(low.startswith("begin:vcard") | low.startswith("mecard:"), out("contact", F.array(F.trim(name)), "info"))
        .when(low.startswith("geo:"), out("location", F.array(rest(5)), "info"))
        .when(low.startswith("otpauth://"), out("authenticator", F.array(code), "high"))
        .when(low.rlike("^(bitcoin|ethereum|litecoin|monero|upi):") | bank, out("payment", paid, "high"))
        .otherwise(out("text", F.array(F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("…"))).otherwise(text)), "info"))
    )
