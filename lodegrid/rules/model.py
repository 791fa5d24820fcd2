"""Rule records and the shared header predicates."""

from __future__ import annotations

from dataclasses import dataclass

from .dsl import Many, Pred, body, ltail, tail

# Access markers looked for in a function header (lower-cased).
ACCESS_MARKERS = (
    "onlyowner", "onlyrole", "onlyadmin", "onlygovernance", "onlygovernor", "onlyproxyadmin",
    "proxycallifnotadmin", "onlyuninitialized", "onlytimelock", "onlyself", "onlymanager",
    "onlyminter", "requiresauth", "authorized", "restricted", "onlyentrypoint", "ifadmin",
    "ifnotadmin", "onlyproxy", "notdelegated",
)
# Inline authorization idioms inside a body.
INLINE_AUTH = (
    r"require\s*\([^;]*?msg\.sender\s*(==|!=)"
    r"|require\s*\([^;]*?_?msgSender\s*\(\s*\)\s*(==|!=)"
    r"|if\s*\([^;{]*\bmsg\.sender\s*(==|!=)[^;{]*\)\s*\{?\s*(revert|return)"
    r"|\brequire(?:Governor|Master|Active|Validator|TokenGovernance|Auth|Owner|"
    r"Admin|Role|Governance|Operator|Manager|Sender|Caller|Lister)\w*\s*\("
    r"|_check(?:Owner|Role|Admin|Access|Auth|Governor|Governance)\w*\s*\("
    r"|_require(?:Owner|Admin|Role|Governance|Auth|Master|Caller|Sender)\w*\s*\("
    r"|\bhasRole\s*\("
    r"|require\s*\([^;]*(?:roles?|controllers?|operators?|keepers?|guardians?|allowed|authorized|permissions?)\s*\[[^;]*msg\.sender"
    r"|if\s*\([^;{]*!\s*(?:roles?|controllers?|operators?|keepers?|guardians?|allowed|authorized|permissions?)\s*\[[^;{]*msg\.sender[^;{]*\)\s*\{?\s*revert"
    r"|(?:isOwner|isAdmin|isGovernor|isAuthorized|_isAuthorized|canCall)\s*\([^;)]*msg\.sender"
    r"|(?:AccessControlUnauthorizedAccount|OwnableUnauthorizedAccount|Unauthorized|NotOwner|NotAdmin)\s*\("
    r"|\bproxyCallIfNotAdmin\b|\bifAdmin\b|\bifNotAdmin\b|\bonlyUninitialized\b"
    r"|isAuthorized|\baccessControlled\b|requiresAuth"
    r"|(?:^|[;{])\s*_?only(?:Owner|Governor|Governance|Admin|Role|Operator|Manager|"
    r"Guardian|Keeper|Minter|Self|Auth|Master|Lister|Validator)\w*\s*\([^;{}]*\)\s*;"
)
# What makes a modifier body an authorization check.
GUARD_BODY = (
    r"msg\.sender|tx\.origin|hasRole|_check(?:Owner|Role|Admin|Access|Auth|Govern)\w*|"
    r"\bonlyRole\b|roles?\s*\[|\bowner\b|\badmin\b|govern|operator|manager|minter|"
    r"controller|guardian|keeper|permission|allowed|authoriz|AccessControlUnauthorizedAccount|OwnableUnauthorizedAccount"
)

is_ext = tail.has(r"\b(public|external)\b", i=False)
is_view = tail.has(r"\b(view|pure)\b", i=False)
is_internal = tail.has(r"\b(internal|private)\b", i=False)
viewish = ltail.has(r"view|pure", i=False)
callable_fn = ~is_internal
header_ac = ltail.has("|".join(ACCESS_MARKERS), i=False)
inline_auth = body.has(INLINE_AUTH)
# A lock call stands at the head of a body: this many characters are looked at.
LOCK_HEAD, WIDE_LOCK_HEAD = 200, 240
nonreentrant = r"nonReentrant|noReentr|reentrancyGuard|_status"

CONFIRM, LEAD = "confirmable", "lead_only"


@dataclass(frozen=True, eq=False)
class Rule:
    detector: str
    key: str                      # rule id; a leading "~" marks "no id, class only"
    impact: float
    conf: float
    when: Pred
    bug: str = ""
    tier: str = ""                # onchain_detectable
    lead: bool = False
    flags: tuple = ()             # evidence booleans set on every hit
    grain: str = "fn"             # fn | file
    target: Pred | None = None    # target-grain condition, joined to the hits
    each: Many | None = None      # one hit per element
    once: bool = False            # first hit per file only
    once_fn: bool = False         # first hit per function name only
    custom_guard: bool = False    # drop hits whose header carries a custom guard modifier
    ultra: bool | None = None     # True: ultra profiles only, False: deep only
    fn: str = ""                  # fixed affected function of file-grain rules
    function: Pred | None = None

    @property
    def rule_id(self) -> str | None:
        return None if self.key.startswith("~") else self.key

    @property
    def is_lead(self) -> bool:
        return self.lead or self.tier == LEAD
