"""Response-header rules, policy content rules, cookie texts and service fingerprints.

Fixed values: header names, finding texts, severities and fingerprints, in catalogue order.
"""

from __future__ import annotations

# (header, check, text, severity); check: present | absent | nosniff | not_wildcard
HEADER_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("content-security-policy", "present",
     "Content-Security-Policy (CSP) header mangler – ingen XSS-beskyttelse", "warning"),
    ("access-control-allow-origin", "not_wildcard",
     "CORS: Access-Control-Allow-Origin er sat til wildcard (*)", "critical"),
    ("x-frame-options", "present", "X-Frame-Options mangler – risiko for clickjacking", "warning"),
    ("x-content-type-options", "nosniff",
     "X-Content-Type-Options: nosniff mangler – MIME-sniffing risiko", "warning"),
    ("x-xss-protection", "present", "X-XSS-Protection header mangler (legacy men stadig relevant)", "info"),
    ("strict-transport-security", "present", "HSTS (Strict-Transport-Security) mangler", "warning"),
    ("cross-origin-opener-policy", "present",
     "Cross-Origin-Opener-Policy (COOP) mangler – Spectre-angreb risiko", "info"),
    ("cross-origin-embedder-policy", "present", "Cross-Origin-Embedder-Policy (COEP) mangler", "info"),
    ("cross-origin-resource-policy", "present", "Cross-Origin-Resource-Policy (CORP) mangler", "info"),
    ("referrer-policy", "present", "Referrer-Policy header mangler – URL kan lækkes til tredjeparter", "info"),
    ("permissions-policy", "present",
     "Permissions-Policy header mangler – ingen kontrol over browser-API'er", "info"),
    ("server", "absent", "Server header eksponerer server-software (info-lækage)", "info"),
    ("x-powered-by", "absent", "X-Powered-By header eksponerer teknologi-stack (info-lækage)", "warning"),
    ("x-aspnet-version", "absent", "X-AspNet-Version eksponerer .NET version", "warning"),
    ("x-aspnetmvc-version", "absent", "X-AspNetMvc-Version eksponerer MVC version", "warning"),
)

# (pattern, text, severity) on the content security policy
CSP_RULES: tuple[tuple[str, str, str], ...] = (
    (r"(?i)'unsafe-inline'", "CSP tillader 'unsafe-inline' scripts – svækker XSS-beskyttelse", "warning"),
    (r"(?i)'unsafe-eval'", "CSP tillader 'unsafe-eval' – svækker XSS-beskyttelse", "warning"),
    (r"(?i)script-src ['\"]?\*", "CSP script-src tillader wildcard (*) – ingen script-begrænsning", "critical"),
    (r"(?i)default-src ['\"]?\*", "CSP default-src er wildcard (*) – ingen begrænsninger", "critical"),
)

# cookie check -> (text, advice)
COOKIE_TEXTS: dict[str, tuple[str, str]] = {
    "httponly": ("Cookie mangler HttpOnly flag – JavaScript kan tilgå cookien (XSS risiko)",
                 "Tilføj HttpOnly til alle session-cookies"),
    "secure": ("Cookie mangler Secure flag – sendes over ukrypteret HTTP",
               "Tilføj Secure til alle cookies med sensitiv data"),
    "samesite": ("Cookie mangler SameSite attribut – risiko for CSRF",
                 "Tilføj SameSite=Strict eller SameSite=Lax"),
    "none_insecure": ("SameSite=None kræver Secure flag – browser vil afvise cookien",
                      "Tilføj Secure til cookie med SameSite=None"),
}

HSTS_MIN_AGE = 31_536_000
HSTS_NO_SUBDOMAINS = "HSTS mangler includeSubDomains"
CORS_CREDENTIALS = ("CORS: wildcard origin + credentials:true – browsers tillader ikke dette, "
                    "men indikerer fejlkonfiguration")

# (service, header)
FINGERPRINTS: tuple[tuple[str, str], ...] = (
    ("Supabase", "x-client-info"), ("Supabase", "sb-gateway-version"), ("Supabase", "x-supabase"),
    ("Firebase", "x-firebase-appcheck"), ("Firebase", "x-firebase-locale"),
    ("Vercel", "x-vercel-id"), ("Vercel", "x-vercel-cache"),
    ("Cloudflare", "cf-ray"), ("Cloudflare", "cf-cache-status"),
    ("Netlify", "x-nf-request-id"), ("Netlify", "netlify-cache-tag"),
    ("Next.js", "x-nextjs-cache"), ("Next.js", "x-nextjs-stale-time"),
)
