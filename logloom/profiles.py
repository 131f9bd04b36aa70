"""What differs between the log families: header forms, noise, categories, filters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from logloom.functions.text import BASE_STEPS, POOL_STEPS, SSO_STEPS, WORD

# --- Fixed values: header patterns -----------------------------------------------------
# Groups in every pattern: ts, level, thread, logger, pid, message (see HeaderPattern).
_LEVEL = "SEVERE|WARNING|TRACE|DEBUG|INFO|WARN|ERROR|FATAL|정보|경고|오류|심각"
_LEVEL_SIGNATURE = "SEVERE|WARNING|TRACE|DEBUG|INFO|WARN|ERROR|FATAL|정보|경고|오류|디버그"


@dataclass(frozen=True)
class HeaderPattern:
    """One header form. ``fields`` gives the group number of each part (0 = absent)."""

    name: str
    regex: str
    ts: int
    level: int
    thread: int
    logger: int
    pid: int
    message: int
    clock_only: bool = False


def _headers(level: str) -> dict[str, HeaderPattern]:
    day = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
    return {
        # 14:13:17.330 [main] DEBUG a.b.Provider - text
        "clock_dash": HeaderPattern(
            "clock_dash",
            rf"^(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3,6}})\s+\[([^\]]+)\]\s+({level})\s+([{WORD}.$\-]+)\s*[:\-]\s*(.*)$",
            ts=1, thread=2, level=3, logger=4, pid=0, message=5, clock_only=True,
        ),
        # 14:13:17.330 [main] DEBUG a.b.Provider -- text
        "clock": HeaderPattern(
            "clock",
            rf"^(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3,6}})\s+\[([^\]]+)\]\s+({level})\s+([{WORD}.$\-]+)\s*(?:--|:)\s*(.*)$",
            ts=1, thread=2, level=3, logger=4, pid=0, message=5, clock_only=True,
        ),
        # 18-Mar-2030 10:51:51.333 WARNING [main] org.x.Y text
        "container": HeaderPattern(
            "container",
            rf"^(\d{{2}}-[A-Za-z]{{3}}-\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})\s+({level})\s+\[([^\]]+)\]\s+([{WORD}.$]+)\s+(.*)$",
            ts=1, level=2, thread=3, logger=4, pid=0, message=5,
        ),
        # 2030-04-24 10:09:19.752 ERROR 121 --- [   main] o.s.App : text
        "framework": HeaderPattern(
            "framework",
            rf"^({day}\.\d{{3,6}})\s+({level})\s+(\d+)?\s*(?:---)?\s*\[\s*([^\]]+)\]\s+([{WORD}.$\-]+)\s*[:\-]\s*(.*)$",
            ts=1, level=2, pid=3, thread=4, logger=5, message=6,
        ),
        # DEBUG 30-03-21 03:34:06[pool adder] [Pool:729] - text
        "short_year": HeaderPattern(
            "short_year",
            rf"^({level})\s+(\d{{2}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\[([^\]]+)\]\s+\[([^\]]+)\]\s*[:\-]\s*(.*)$",
            level=1, ts=2, thread=3, logger=4, pid=0, message=5,
        ),
        # 2030-04-24 10:09:19,752 ERROR [main] com.x.Foo - text
        "simple": HeaderPattern(
            "simple",
            rf"^({day}[.,]\d{{3,6}})\s+({level})\s+\[([^\]]+)\]\s+([{WORD}.$]+)\s*[:\-]\s*(.*)$",
            ts=1, level=2, thread=3, logger=4, pid=0, message=5,
        ),
        # [DEBUG][14:15:18][exec-9][com.x.Y.run] - text
        "agent": HeaderPattern(
            "agent",
            rf"^\[({level})\]\[(\d{{2}}:\d{{2}}:\d{{2}})\]\[([^\]]+)\]\[([^\]]+)\]\s*-\s*(.*)$",
            level=1, ts=2, thread=3, logger=4, pid=0, message=5, clock_only=True,
        ),
    }


# --- Fixed values: noise ---------------------------------------------------------------
_NOISE_REGEX = (
    r"^NOTE:\s+Picked up JDK_JAVA_OPTIONS:",
    r"^INFO:\s+Picked up JDK_JAVA_OPTIONS:",
    r"^\s*$",
    r"^---+.*---+$",
)
_NOISE_REGEX_POOL = _NOISE_REGEX + (r"^Logging system failed to initialize",)
_NOISE_TERMS = (
    "Command line argument:",
    "At least one JAR was scanned for TLDs",
    "Skipping unneeded JARs during scanning",
    "Enable debug logging for this logger",
)
_NOISE_TERMS_POOL = _NOISE_TERMS + (
    "Pool stats",
    "Fill pool skipped",
    "batch acquisition of 0 triggers",
    "connection closer",
    "connection adder",
)

# --- Fixed values: low-value records ---------------------------------------------------
_DROP_TERMS = (
    "starting", "stopping", "initialized", "loaded", "deployed",
    "deployment", "version", "build", "home", "argument",
)
_KEEP_DEBUG_SSO = (
    "라이센스", "license", "expired", "만료",
    "crypto", "cryptoapi", "self test", "암호화",
    "authnrequest", "response", "assertion", "saml", "sso",
    "failed", "cannot", "error", "exception", "timeout", "connection",
    "dbconnect", "repository",
    "auth", "login", "security", "permission", "denied",
    "provider", "identificationprovider",
    "initialization", "환경", "config",
)
_KEEP_DEBUG_IAM = (
    "failed", "cannot", "error", "exception", "timeout", "connection attempt failed",
    "cannot acquire connection", "psqlexception",
    "account", "auth", "login", "security", "permission", "denied", "jndi",
    "namingexception", "binding",
    "accountmapper", "admnmapper", "apiusermapper", "apirolemapper", "mapper",
    "configuration", "hikariconfig", "connectiontimeout", "validationtimeout",
    "initializationfailtimeout",
    "yugabyte", "hikaripool", "poolbase",
)
_KEEP_DEBUG_SIGNATURE = (
    "signeddataverifier", "certificateverifier", "signature", "certificate",
    "sign", "cert", "verify", "validation",
    "failed", "cannot", "error", "exception", "timeout", "connection",
    "cannot acquire connection", "psqlexception", "sqlexception",
    "auth", "login", "security", "permission", "denied", "access",
    "session", "token", "credential",
    "configuration", "hikariconfig", "connectiontimeout", "validationtimeout",
    "initializationfailtimeout", "jndi", "namingexception",
    "hikaripool", "poolbase", "connection attempt failed",
    "mapper",
)

# --- Fixed values: categories, in order of test ----------------------------------------
# (category, where, terms): where is "logger" or "message", compared in lower case.
_CAT_SYSTEM = ("SYSTEM", "logger", ("catalina", "tomcat", "bootstrap"))
_CAT_SECURITY = ("SECURITY", "logger", ("security", "auth", "ssl", "cert"))
_CAT_NETWORK = ("NETWORK", "logger", ("http", "nio", "coyote", "connector"))
_CAT_APPLICATION = ("APPLICATION", "logger", ("servlet", "jsp", "filter", "valve"))
_CAT_DATABASE = ("DATABASE", "logger", ("sql", "jdbc", "database", "datasource"))
_CAT_POOL = (
    "DATABASE", "logger", ("sql", "jdbc", "database", "datasource", "hikari", "connection"),
)
_CAT_SCHEDULER = ("SCHEDULER", "logger", ("quartz", "scheduler", "job"))
_CAT_COMPILER = ("COMPILER", "logger", ("compiler", "jasper", "jdt"))
_CAT_FRAMEWORK = ("FRAMEWORK", "logger", ("spring", "boot", "context"))
_CATEGORIES_SIGNATURE = (
    _CAT_SYSTEM, _CAT_SECURITY, _CAT_NETWORK, _CAT_APPLICATION, _CAT_DATABASE, _CAT_COMPILER,
)
_CATEGORIES_IAM = (
    _CAT_SYSTEM, _CAT_SECURITY, _CAT_NETWORK, _CAT_APPLICATION, _CAT_POOL,
    _CAT_SCHEDULER, _CAT_COMPILER, _CAT_FRAMEWORK,
)
_CATEGORIES_SSO = (
    ("LICENSE", "message", ("라이센스", "license")),
    ("SAML", "message",
     ("authnrequest", "response", "assertion", "saml2p:", "saml2:", "xmlsecurity", "signature")),
    ("CRYPTO", "message", ("cryptoapi", "crypto initialization", "self test")),
    ("SSO_PROVIDER", "logger", ("provider", "identificationprovider")),
    ("REPOSITORY", "logger", ("repository", "dbconnect")),
) + _CATEGORIES_IAM


@dataclass(frozen=True)
class LogProfile:
    """Rules of one log family."""

    name: str
    headers: tuple[HeaderPattern, ...]
    noise_regex: tuple[str, ...]
    noise_terms: tuple[str, ...]
    template_steps: tuple[str, ...]
    categories: tuple[tuple[str, str, tuple[str, ...]], ...]
    keep_debug: tuple[str, ...] = ()
    drop_terms: tuple[str, ...] = _DROP_TERMS
    xml_blocks: bool = False
    two_digit_year: bool = True
    timing_aware_codes: bool = False
    keep_loggers: tuple[str, ...] = ()  # always kept, whatever the level
    pool_fields: bool = False
    sso_fields: bool = False
    signature_fields: bool = False
    protect_errors: bool = False  # True keeps ERROR and FATAL from the drop terms
    extra: dict = field(default_factory=dict, hash=False)

    def with_terms(self, keep_debug: tuple[str, ...] = (), crypto: tuple[str, ...] = ()) -> LogProfile:
        """The same rules with the component names of one's own installation added.

        ``keep_debug`` are lower-case terms that save DEBUG records; ``crypto`` are
        lower-case message terms of the CRYPTO category.
        """
        categories = tuple(
            (name, where, terms + crypto if name == "CRYPTO" else terms)
            for name, where, terms in self.categories
        )
        return replace(self, keep_debug=self.keep_debug + keep_debug, categories=categories)

    def options(self, **changes) -> LogProfile:
        """The same rules with some switches changed."""
        return replace(self, **changes)


_H = _headers(_LEVEL)
_HS = _headers(_LEVEL_SIGNATURE)

SSO = LogProfile(
    name="sso",
    headers=tuple(_H[n] for n in ("clock_dash", "container", "framework", "short_year", "simple")),
    noise_regex=_NOISE_REGEX_POOL,
    noise_terms=_NOISE_TERMS_POOL,
    template_steps=SSO_STEPS,
    categories=_CATEGORIES_SSO,
    keep_debug=_KEEP_DEBUG_SSO,
    xml_blocks=True,
    sso_fields=True,
)
IAM = LogProfile(
    name="iam",
    headers=tuple(_H[n] for n in ("container", "framework", "short_year", "simple", "clock")),
    noise_regex=_NOISE_REGEX_POOL,
    noise_terms=_NOISE_TERMS_POOL,
    template_steps=POOL_STEPS,
    categories=_CATEGORIES_IAM,
    keep_debug=_KEEP_DEBUG_IAM,
    pool_fields=True,
)
SIGNATURE = LogProfile(
    name="signature",
    headers=tuple(_HS[n] for n in ("container", "framework", "simple", "clock")),
    noise_regex=_NOISE_REGEX,
    noise_terms=_NOISE_TERMS,
    template_steps=BASE_STEPS,
    categories=_CATEGORIES_SIGNATURE,
    keep_debug=_KEEP_DEBUG_SIGNATURE,
    two_digit_year=False,
    timing_aware_codes=True,
    signature_fields=True,
)
# Earlier form of the signature rules: no DEBUG record survives unless its logger is a
# signature logger, one more drop term, plain error codes.
SIGNATURE_EARLIER = replace(
    SIGNATURE,
    name="signature_earlier",
    keep_debug=(),
    drop_terms=_DROP_TERMS + ("configuration",),
    keep_loggers=("SignedDataVerifier", "CertificateVerifier"),
    timing_aware_codes=False,
)
# Service-provider agent logs: clock-only headers in brackets.
AGENT = replace(SSO, name="agent", headers=(_H["agent"],) + SSO.headers)

PROFILES = {p.name: p for p in (SSO, IAM, SIGNATURE, SIGNATURE_EARLIER, AGENT)}
