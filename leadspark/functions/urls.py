"""Hosts, registrable domains and paths of URLs, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of several labels under which names are registered, by registries and by hosts of tenants.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "me.uk", "ltd.uk", "plc.uk", "co.kr", "or.kr", "ne.kr", "re.kr", "go.kr", "pe.kr", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "gr.jp",
    "com.br", "com.cn", "net.cn", "org.cn", "com.hk", "com.sg", "com.my", "com.tr", "co.za", "com.mx", "co.nz", "com.ar", "com.ae", "co.in", "com.vn", "co.id", "com.ph", "com.sa", "com.qa", "com.kw", "com.bh", "com.om", "com.eg", "com.jo", "com.lb",
    "co.il", "com.pk", "com.bd", "com.lk", "com.np", "co.th", "in.th", "com.tw", "com.co", "com.pe", "com.uy", "com.ec", "com.ve", "com.do", "com.gt", "co.cr", "com.ng", "com.gh", "co.ke", "com.tn", "com.ua", "com.pl", "com.ro", "com.ru", "com.gr", "com.cy", "com.pt", "com.es",
    "cafe24.com", "imweb.me", "modoo.at", "creatorlink.net", "tistory.com", "smartstore.naver.com", "blog.naver.com", "post.naver.com", "myshopify.com", "wixsite.com", "editorx.io", "blogspot.com", "wordpress.com", "tumblr.com", "pages.dev", "workers.dev", "netlify.app", "vercel.app",
    "github.io", "gitlab.io", "web.app", "firebaseapp.com", "appspot.com", "herokuapp.com", "azurewebsites.net", "onrender.com", "webflow.io", "weebly.com", "squarespace.com", "bigcartel.com", "mystrikingly.com", "jimdosite.com", "jimdofree.com", "godaddysites.com", "business.site", "notion.site", "glitch.me", "carrd.co", "framer.website",
)
#: Labels that a registry, not a company, owns right below a country's two letters.
REGISTRY_LABELS = ("ac", "ad", "asso", "biz", "co", "com", "ed", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "gr", "ind", "info", "lg", "ltd", "me", "mil", "mun", "ne", "net", "nom", "or", "org", "plc", "pro", "re", "res", "sch", "store", "tm", "web")


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and trailing dot; NULL for none or an IPv6 literal."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    bare = F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*$", "")
    name = F.regexp_replace(F.lower(bare), r"\.+$", "")
    return F.when((name != "") & ~name.contains("[") & ~name.contains(":"), name)


def canonical_domain(url: Column) -> Column:
    """The registrable domain: one label more than the longest known suffix, or than one of a registry's shape
    (com.pk) in a host of three labels or more; else two labels. NULL for a suffix itself, IPv4, a single label, and a host that
    is no plain ASCII domain: no key is better than one that strangers share. A host written in other letters is NULL
    unless it comes in its ASCII form."""
    h = F.regexp_replace(host(url), r"^(?:www\.)+", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), k), ".")
    known = lambda k: (n >= k) & last(k).isin(*[x for x in SUFFIXES if x.count(".") == k - 1])
    shaped = (n >= 3) & F.get(labels, n - 2).isin(*REGISTRY_LABELS) & F.get(labels, n - 1).rlike("^[a-z]{2}$")
    found = F.when(known(3), F.when(n > 3, last(4))).when(known(2), F.when(n > 2, last(3))).when(shaped, last(3)).otherwise(last(2))
    plain = found.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
    return F.when(h.isNotNull() & (n >= 2) & ~h.rlike(r"^[0-9]+(\.[0-9]+)*$") & plain, found)


def subdomain(url: Column) -> Column:
    """Labels before the registrable domain without a leading www; empty if none."""
    h, d = host(url), canonical_domain(url)
    before = F.substring(h, F.lit(1), F.char_length(h) - F.char_length(d))
    return F.when(d.isNotNull(), F.regexp_replace(F.regexp_replace(before, r"\.$", ""), r"^www(\.|$)", ""))


def path(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"^$", "/")


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def site_root(url: Column, tenant_domains: tuple[str, ...] = ()) -> Column:
    """scheme://host/, and the first path segment where the host serves tenants by path."""
    root = F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"))
    if not tenant_domains:
        return root
    tenant = F.get(F.filter(F.split(path(url), "/"), lambda x: x != ""), F.lit(0))
    return F.when(canonical_domain(url).isin(*tenant_domains) & tenant.isNotNull(), F.concat(root, tenant, F.lit("/"))).otherwise(root)


def email_domain(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))
