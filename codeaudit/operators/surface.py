"""Live-surface checks (H1–H9) over captured observations.

``http_obs(host, url, status, final_url, headers map, set_cookie array, error)``
is one fetched response of a target (header names lower-cased);
``probe_obs(host, base, path, status, body binary)`` one probe of a
well-known path; ``tls_obs(host, version, not_after, verify_error)`` one TLS
handshake.  ``now`` is a parameter so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import rules as R

SCANNER = "surface"
HEADERS_REF = "https://owasp.org/www-project-secure-headers/"


def _f(host_col: Column, id_: Column, title: Column, sev: Column, path: Column, evidence: Column,
       remediation: Column, reference: Column | None = None) -> list[Column]:
    return [host_col.alias("repo_id"), id_.alias("id"), title.alias("title"), sev.alias("severity"),
            F.lit(SCANNER).alias("scanner"), path.alias("path"), F.lit(0).alias("line"),
            evidence.alias("evidence"), remediation.alias("remediation"),
            (reference if reference is not None else F.lit("")).alias("reference")]


_FIXES = {"strict-transport-security": "Send Strict-Transport-Security with a long max-age.",
          "content-security-policy": "Ship a Content-Security-Policy, report-only first.",
          "x-content-type-options": "Send X-Content-Type-Options: nosniff.",
          "referrer-policy": "Send a strict Referrer-Policy.",
          "permissions-policy": "Send a Permissions-Policy that disables unused features.",
          "x-frame-options": "Send X-Frame-Options: DENY or CSP frame-ancestors."}


def _item(id_: Column, title: Column, sev: Column, evidence: Column, remediation: Column,
          reference: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), title.alias("title"), sev.alias("severity"), evidence.alias("evidence"),
                    remediation.alias("remediation"), (reference if reference is not None else F.lit("")).alias("reference"))


def header_findings(http_obs: DataFrame) -> DataFrame:
    """H1–H6 per reachable response, one pass: every check contributes
    optional finding structs to one array per observation, exploded once.
    A failed fetch is reported once (info) and gets no header checks."""
    h = F.col("headers")
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    hsts, csp = h["strict-transport-security"], h["content-security-policy"]
    age = F.regexp_extract(hsts, r"max-age=([^;]*)", 1).try_cast("bigint")
    items = [F.when(~ok, _item(F.lit("surface/unreachable"), F.concat(F.lit("Could not reach "), F.col("url")),
                               F.lit("info"), F.col("error"), F.lit("Check the hostname, or pass the scheme-less domain.")))]
    for k, sev, title in R.REQUIRED_HEADERS:  # H1
        items.append(F.when(ok & ~F.map_contains_key(h, k), _item(
            F.lit(f"surface/{k}"), F.lit(title), F.lit(sev), F.lit("header absent"), F.lit(_FIXES[k]), F.lit(HEADERS_REF))))
    items.append(F.when(ok & hsts.isNotNull() & hsts.contains("max-age=") & (age < R.HSTS_MIN_AGE), _item(  # H2
        F.lit("surface/hsts-short"), F.lit("HSTS max-age below 180 days"), F.lit("low"), hsts,
        F.lit("Raise max-age to a year once HTTPS coverage is complete."))))
    items.append(F.when(ok & csp.isNotNull() & csp.contains("unsafe-inline"), _item(  # H3
        F.lit("surface/csp-unsafe-inline"), F.lit("CSP allows 'unsafe-inline'"), F.lit("medium"), F.substring(csp, 1, 140),
        F.lit("Replace 'unsafe-inline' with nonces or hashes."))))
    for k in R.LEAKY_HEADERS:  # H4
        v = h[k]
        items.append(F.when(ok & v.isNotNull() & (F.trim(v) != ""), _item(
            F.lit("surface/version-disclosure"), F.lit(f"Server version disclosed via `{k}`"), F.lit("low"),
            F.concat(F.lit(f"{k}: "), v), F.lit(f"Strip the `{k}` header at the proxy."))))
    items.append(F.when(ok & (h["access-control-allow-origin"] == "*"), _item(  # H5
        F.lit("surface/cors-wildcard"), F.lit("Live response sends Access-Control-Allow-Origin: *"), F.lit("medium"),
        F.lit("ACAO: *"), F.lit("Restrict to an explicit origin allowlist."))))

    def cookie(c: Column) -> Column:  # H6
        low = F.lower(c)
        miss = F.filter(F.array(F.lit("secure"), F.lit("httponly"), F.lit("samesite")), lambda x: ~low.contains(x))
        return F.when(F.size(miss) > 0, _item(
            F.lit("surface/cookie-flags"), F.concat(F.lit("Cookie missing "), F.array_join(miss, ", ")), F.lit("medium"),
            F.substring(F.split(c, "=")[0], 1, 40), F.lit("Set Secure; HttpOnly; SameSite on session cookies."),
            F.lit("https://cwe.mitre.org/data/definitions/1004.html")))
    cookies = F.when(ok, F.transform(F.coalesce("set_cookie", F.array().cast("array<string>")), cookie))
    item_type = "array<struct<id:string,title:string,severity:string,evidence:string,remediation:string,reference:string>>"
    all_items = F.concat(F.array(*items), F.coalesce(cookies, F.array().cast(item_type)))
    x = http_obs.select("host", "url", F.explode(F.filter(all_items, lambda e: e.isNotNull())).alias("f"))
    return x.select(F.col("host").alias("repo_id"), "f.id", "f.title", "f.severity", F.lit(SCANNER).alias("scanner"),
                    F.col("url").alias("path"), F.lit(0).alias("line"), "f.evidence", "f.remediation", "f.reference")


def redirect_findings(plain_obs: DataFrame) -> DataFrame:
    """H7: the plain-HTTP fetch did not end on https."""
    return plain_obs.filter((F.col("error").isNull() | (F.col("error") == "")) & ~F.col("final_url").startswith("https://")) \
        .select(*_f(F.col("host"), F.lit("surface/no-https-redirect"), F.lit("HTTP does not redirect to HTTPS"),
                    F.lit("high"), F.concat(F.lit("http://"), F.col("host")), F.col("final_url"),
                    F.lit("Redirect all HTTP traffic to HTTPS at the edge.")))


def probe_findings(probe_obs: DataFrame) -> DataFrame:
    """H8: 200 with a non-empty body that is not an HTML page → exposed;
    security.txt inverted (missing → info)."""
    meta = F.create_map(*[x for p, s, t in R.PROBE_PATHS for x in (F.lit(p), F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")))])
    p = probe_obs.withColumn("m", meta[F.col("path")]).filter(F.col("m").isNotNull())
    body = F.coalesce(F.col("body"), F.lit(b"").cast("binary"))
    found = (F.col("status") == 200) & (F.length(body) > 0)
    head = F.lower(F.decode(F.substring(body, 1, 60), "UTF-8"))
    is_sec = F.col("path").endswith("security.txt")
    url = F.concat(F.col("base"), F.col("path"))
    a = p.filter(is_sec & ~found).select(*_f(
        F.col("host"), F.lit("surface/no-security-txt"), F.col("m.t"), F.lit("info"), url,
        F.concat(F.lit("HTTP "), F.col("status").cast("string")),
        F.lit("Publish /.well-known/security.txt with a contact address.")))
    b = p.filter(~is_sec & found & ~head.contains("<!doctype html")).select(*_f(
        F.col("host"), F.lit("surface/exposed-path"), F.col("m.t"), F.col("m.s"), url,
        F.concat(F.lit("HTTP 200, "), F.length(body).cast("string"), F.lit("+ bytes")),
        F.lit("Block the path at the server/CDN and rotate anything it exposed.")))
    return a.unionByName(b)


def tls_findings(tls_obs: DataFrame, now: str) -> DataFrame:
    """H9: invalid chain → critical (only that); TLS 1.0/1.1 → high; expiry in
    under 21 days medium, under 8 high.  ``now`` should carry its zone
    (e.g. ``2025-01-01T00:00:00Z``) so the result does not depend on the
    session time zone."""
    bad = F.coalesce(F.col("verify_error"), F.lit("")) != ""
    a = tls_obs.filter(bad).select(*_f(
        F.col("host"), F.lit("surface/tls-invalid"), F.lit("TLS certificate does not validate"), F.lit("critical"),
        F.col("host"), F.substring("verify_error", 1, 140), F.lit("Fix the chain or hostname, or renew the certificate.")))
    ok = tls_obs.filter(~bad)
    b = ok.filter(F.col("version").isin("TLSv1", "TLSv1.1")).select(*_f(
        F.col("host"), F.lit("surface/tls-old"), F.concat(F.lit("Negotiated "), F.col("version")), F.lit("high"),
        F.col("host"), F.col("version"), F.lit("Disable TLS below 1.2 at the load balancer.")))
    exp = F.try_to_timestamp(F.regexp_replace(F.col("not_after"), r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy z"))
    secs = F.unix_timestamp(exp) - F.unix_timestamp(F.lit(now).cast("timestamp"))
    days = F.floor(secs / 86400).cast("long")
    c = ok.withColumn("days", days).filter(F.col("days").isNotNull() & (F.col("days") < R.CERT_WARN_DAYS)).select(*_f(
        F.col("host"), F.lit("surface/cert-expiring"),
        F.concat(F.lit("TLS certificate expires in "), F.col("days").cast("string"), F.lit(" days")),
        F.when(F.col("days") < R.CERT_HIGH_DAYS, "high").otherwise("medium"), F.col("host"), F.col("not_after"),
        F.lit("Renew now and automate renewal with expiry alerting.")))
    return a.unionByName(b).unionByName(c)
