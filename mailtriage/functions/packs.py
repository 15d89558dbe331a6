"""Rule packs, keyword patterns and thresholds.

FIXED VALUES. The patterns, rule ids, reason texts and thresholds below must
equal the behaviour being matched, so they are stated here plainly, in their
natural order, as data. Patterns are written in the Python/Java regex dialect
and are matched case-insensitively (see ``functions.regex``).

Three packs exist and differ: ``packages`` (older), ``api`` and ``web``; the
``web`` pack is the one the triage job runs by default. One entry of the web
pack names a private person's mail address; it is not shipped here.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# Thresholds and windows
# ---------------------------------------------------------------------------
ML_SPAM_THRESHOLD = 0.85          # p(spam) >= this -> trash
GRACE_PERIOD_DAYS = 7             # unread keep-mail younger than this is protected
UNCERTAIN_BAND = (0.3, 0.7)       # open interval
TRIAGE_WINDOW_DAYS = 30
OBSERVE_WINDOW_DAYS = 2
BOOTSTRAP_WINDOW_DAYS = 365
INBOX_KEEP_AGE_DAYS = 30          # bootstrap: read inbox mail older than this -> keep
REVIEW_WINDOW = "7 days"
REVIEW_LIMIT = 100
STATS_WINDOW = "24 hours"
OUTBOX_GROUP_SIZE = 1000
SNIPPET_CHARS, SUBJECT_SAMPLE_CHARS, REVIEW_SNIPPET_CHARS, REPORT_SUBJECT_CHARS = 200, 70, 100, 60

# Reason texts per layer (the rule id is appended).
REASON_PREFIX = {
    "combo": "sender+subject match: ",
    "keep_domain": "keep-domain: ",
    "keep_subject": "keep-subject: ",
    "deletable_domain": "delete-domain: ",
}
LAYER_DECISION = {"combo": "keep", "keep_domain": "keep", "keep_subject": "keep",
                  "deletable_domain": "deletable"}
LAYERS = ("combo", "keep_domain", "keep_subject", "deletable_domain")

# ---------------------------------------------------------------------------
# Rules shared by all three packs
# ---------------------------------------------------------------------------
COMBO_RULES = [  # (sender pattern, subject pattern, rule id)
    (r"business-updates\.facebook\.com$", r"potwierdzenie\s+p[łl]atno|transakcj", "meta_ads_billing"),
]

DELETABLE_DOMAIN_RULES = [
    (r"(^|\.)temuemail\.com$", "promo_temu"),
    (r"(^|\.)newsletter\.allegro\.pl$", "promo_allegro_newsletter"),
    (r"(^|\.)info\.biedronka\.pl$", "promo_biedronka"),
    (r"(^|\.)updates\.otomoto\.pl$", "promo_otomoto"),
    (r"(^|\.)mail\.beehiiv\.com$", "promo_beehiiv_newsletter"),
]

# ---------------------------------------------------------------------------
# Web pack (the one the triage job runs)
# ---------------------------------------------------------------------------
WEB_KEEP_DOMAIN_RULES = [
    (r"(^|\.)mbank\.pl$", "bank_mbank"),
    (r"(^|\.)santander\.", "bank_santander"),
    (r"(^|\.)pkobp\.pl$", "bank_pko"),
    (r"(^|\.)ingbank\.pl$", "bank_ing"),
    (r"(^|\.)millennium(bank)?\.pl$", "bank_millennium"),
    (r"(^|\.)unicredit\.pl$", "payment_inpost_unicredit"),
    (r"(^|\.)allegropay\.pl$", "payment_allegropay"),
    (r"security@vercel\.com$", "vercel_security"),
    (r"notifications@vercel\.com$", "vercel_ops"),
    (r"(^|\.)adwokatwolkiewicz\.pl$", "legal_kancelaria"),
    (r"(^|\.)startedu\.pl$", "family_school"),
    (r"(^|\.)eduindex\.pl$", "family_school_eduindex"),
    (r"(^|\.)biznesradar\.pl$", "investing_biznesradar"),
    (r"(^|\.)hycom\.pl$", "company_hycom"),
    (r"(^|\.)autenti\.com$", "esign_autenti"),
    (r"(^|\.)mail\.autenti\.com$", "esign_autenti_mail"),
    (r"(^|\.)aitinkerers\.org$", "newsletter_aitinkerers"),
    (r"(^|\.)mail\.aitinkerers\.org$", "newsletter_aitinkerers_mail"),
    (r"(^|\.)zus\.pl$", "gov_zus"),
    (r"(^|\.)us\.gov\.pl$", "gov_us"),
    (r"(^|\.)epuap\.gov\.pl$", "gov_epuap"),
    (r"(^|\.)podatki\.gov\.pl$", "gov_podatki"),
    (r"(^|\.)biznes\.gov\.pl$", "gov_biznes"),
    (r"(^|\.)google\.com$", "google_official"),
    (r"search-console-noreply@google\.com$", "google_search_console"),
    (r"(^|\.)googlewebmastercentral\.com$", "google_webmaster"),
    # (one rule naming a private person's address is left out here)
    (r"warsawainews@substack\.com$", "newsletter_warsawai"),
    (r"(^|\.)moznainaczej\.edu\.pl$", "education_unconference"),
]

WEB_KEEP_SUBJECT_RULES = [
    (r"\bfaktur", "kw_invoice_subject"),
    (r"\b(invoice|receipt|paragon|rachunek)", "kw_invoice_en"),
    (r"\btermin\s+p[łl]atn", "kw_payment_due"),
    (r"\bdo\s+zap[łl]aty", "kw_to_pay"),
    (r"potwierdzenie\s+p[łl]atno", "kw_payment_confirmation"),
    (r"\bkupi[łl]e[śs]\s+i\s+zap[łl]aci[łl]e[śs]", "kw_allegro_purchase"),
    (r"\bzam[oó]wieni", "kw_order"),
    (r"delivery\s+status\s+notification.*fail", "kw_bounce"),
    (r"security\s+(update|incident|alert|breach)", "kw_security_alert"),
    (r"failed\s+(production\s+)?deployment", "kw_deploy_fail"),
    (r"\bzmiana\s+regulaminu|aktualizuj.*dokumenty", "kw_tos_change"),
    (r"\bPIT\s+(roczn|11|37|36|28)", "kw_pit_tax"),
    (r"\bg[łl]osowani|\bkarta\s+do\s+g[łl]osowania", "kw_voting"),
    (r"\b(NWZA|NWZ|WZA|ZWZA)\b|\bwalne\s+zgromadzenie|\bzgromadzenie\s+akcjonariusz|\bakcjonariusz",
     "kw_shareholders_meeting"),
    (r"\bZUS\b", "kw_zus"),
    (r"\b(pismo|decyzj|wezwani|zawiadomieni)\b.*\b(urz[ąa]d|s[ąa]d|ZUS|skarbowy)", "kw_gov_official"),
    (r"search\s+console|indeksowani|noindex|sitemap", "kw_search_console"),
]

# ---------------------------------------------------------------------------
# Api pack
# ---------------------------------------------------------------------------
API_KEEP_DOMAIN_RULES = [
    (r"(^|\.)mbank\.pl$", "bank_mbank"),
    (r"(^|\.)santander\.", "bank_santander"),
    (r"(^|\.)pkobp\.pl$", "bank_pko"),
    (r"(^|\.)ingbank\.pl$", "bank_ing"),
    (r"(^|\.)millennium(bank)?\.pl$", "bank_millennium"),
    (r"(^|\.)unicredit\.pl$", "payment_inpost_unicredit"),
    (r"(^|\.)allegropay\.pl$", "payment_allegropay"),
    (r"security@vercel\.com$", "vercel_security"),
    (r"notifications@vercel\.com$", "vercel_ops"),
    (r"(^|\.)adwokatwolkiewicz\.pl$", "legal_kancelaria"),
    (r"(^|\.)startedu\.pl$", "family_school"),
    (r"(^|\.)zus\.pl$", "gov_zus"),
    (r"(^|\.)us\.gov\.pl$", "gov_us"),
    (r"(^|\.)epuap\.gov\.pl$", "gov_epuap"),
    (r"(^|\.)podatki\.gov\.pl$", "gov_podatki"),
    (r"(^|\.)biznes\.gov\.pl$", "gov_biznes"),
]

API_KEEP_SUBJECT_RULES = [
    (r"\bfaktur", "kw_invoice_subject"),
    (r"\b(invoice|receipt|paragon|rachunek)", "kw_invoice_en"),
    (r"\btermin\s+p[łl]atn", "kw_payment_due"),
    (r"\bdo\s+zap[łl]aty", "kw_to_pay"),
    (r"potwierdzenie\s+p[łl]atno", "kw_payment_confirmation"),
    (r"\bkupi[łl]e[śs]\s+i\s+zap[łl]aci[łl]e[śs]", "kw_allegro_purchase"),
    (r"\bzam[oó]wieni", "kw_order"),
    (r"delivery\s+status\s+notification.*fail", "kw_bounce"),
    (r"security\s+(update|incident|alert|breach)", "kw_security_alert"),
    (r"failed\s+(production\s+)?deployment", "kw_deploy_fail"),
    (r"\bzmiana\s+regulaminu|aktualizuj.*dokumenty", "kw_tos_change"),
    (r"\bPIT\s+(roczn|11|37|36|28)", "kw_pit_tax"),
    (r"\bg[łl]osowani|\bkarta\s+do\s+g[łl]osowania", "kw_voting"),
    (r"\bZUS\b", "kw_zus"),
    (r"\b(pismo|decyzj|wezwani|zawiadomieni)\b.*\b(urz[ąa]d|s[ąa]d|ZUS|skarbowy)", "kw_gov_official"),
]

# ---------------------------------------------------------------------------
# Packages pack (older; subject stems end in \b)
# ---------------------------------------------------------------------------
PACKAGES_KEEP_DOMAIN_RULES = [
    (r"(^|\.)mbank\.pl$", "bank_mbank"),
    (r"(^|\.)santander\.", "bank_santander"),
    (r"(^|\.)pkobp\.pl$", "bank_pko"),
    (r"(^|\.)ingbank\.pl$", "bank_ing"),
    (r"(^|\.)millennium(bank)?\.pl$", "bank_millennium"),
    (r"(^|\.)unicredit\.pl$", "payment_inpost_unicredit"),
    (r"(^|\.)allegropay\.pl$", "payment_allegropay"),
    (r"security@vercel\.com$", "vercel_security"),
    (r"notifications@vercel\.com$", "vercel_ops"),
    (r"(^|\.)adwokatwolkiewicz\.pl$", "legal_kancelaria"),
    (r"(^|\.)startedu\.pl$", "family_school"),
]

PACKAGES_KEEP_SUBJECT_RULES = [
    (r"\b(faktur|invoice|rachunek)\b", "kw_invoice_subject"),
    (r"\btermin\s+p[łl]atn", "kw_payment_due"),
    (r"\bdo\s+zap[łl]aty\b", "kw_to_pay"),
    (r"potwierdzenie\s+p[łl]atno", "kw_payment_confirmation"),
    (r"\bKupi[łl]e[śs]\s+i\s+zap[łl]aci[łl]e[śs]\b", "kw_allegro_purchase"),
    (r"delivery\s+status\s+notification.*fail", "kw_bounce"),
    (r"security\s+(update|incident|alert|breach)", "kw_security_alert"),
    (r"failed\s+(production\s+)?deployment", "kw_deploy_fail"),
    (r"\bzmiana\s+regulaminu\b|aktualizuj.*dokumenty", "kw_tos_change"),
]

# ---------------------------------------------------------------------------
# Read-later senders (labeling) and subject keyword flags (features)
# ---------------------------------------------------------------------------
READ_LATER_PATTERN = (r"(substack\.com|linkedin\.com|deeplearning\.ai|strefainwestorow|"
                      r"subiektywnieofinansach|biznesradar\.pl|sygna[łl]\s?ai)")

KEYWORD_PATTERNS = [  # (feature name, pattern on subject)
    ("kw_invoice", r"\b(faktur|invoice|receipt|paragon|rachunek)"),
    ("kw_order", r"\b(zam[óo]wienie|order|kupi[ae][łl]e[śs]|purchase|zap[łl]aci[łl]e[śs])"),
    ("kw_return", r"\b(zwrot|refund|return)"),
    ("kw_delivery", r"\b(przesy[łl]k|dostaw|delivery|shipment|tracking|track.?your)"),
    ("kw_social", r"\b(reacted|liked|commented|mentioned|follow|followed)"),
    ("kw_newsletter", r"\b(newsletter|daily|weekly|digest|roundup|update)"),
    ("kw_notification", r"\b(notification|notified|alert|reminder)"),
    ("kw_unsubscribe", r"\b(unsubscribe|opt.?out|wypisz|rezygnacj)"),
    ("kw_message", r"\b(message|wiadomo[śs][ćc]|messaged|wrote)"),
    ("kw_reply_fwd", r"^(re|odp|fw|fwd|pd):\s"),
    ("kw_verification", r"\b(verify|verification|confirm|potwierd[źz])"),
    ("kw_security", r"\b(password|login|sign.?in|security|bezpiecze[ńn]stw)"),
]
NUMERIC_COLS = ["subject_len", "snippet_len", "age_days", "hour_received"]
KEYWORD_COLS = [k for k, _ in KEYWORD_PATTERNS]

# Bootstrap sources in their fixed order (first source wins) and their labels.
BOOTSTRAP_SOURCES = ["bootstrap_trash", "bootstrap_spam", "bootstrap_archived", "bootstrap_inbox"]
BOOTSTRAP_LABEL = {"bootstrap_trash": "spam", "bootstrap_spam": "spam",
                   "bootstrap_archived": "keep", "bootstrap_inbox": None}

# Documented class names vs. the names used in code.
CLASS_TAXONOMY = {"handled_done": "archival_after_handled", "keep_critical": "transactional_keep",
                  "deletable_now": "deletable_now", "read_later": "read_later"}

FINAL_STATES = ["deleted", "read_kept", "unread_kept", "archived", "starred", "spam_folder"]
DECISION_VALUES = ["spam", "keep", "uncertain"]
USER_LABELS = ["spam", "keep"]

PACKS = {
    "web": {"combo": COMBO_RULES, "keep_domain": WEB_KEEP_DOMAIN_RULES,
            "keep_subject": WEB_KEEP_SUBJECT_RULES, "deletable_domain": DELETABLE_DOMAIN_RULES},
    "api": {"combo": COMBO_RULES, "keep_domain": API_KEEP_DOMAIN_RULES,
            "keep_subject": API_KEEP_SUBJECT_RULES, "deletable_domain": DELETABLE_DOMAIN_RULES},
    "packages": {"combo": COMBO_RULES, "keep_domain": PACKAGES_KEEP_DOMAIN_RULES,
                 "keep_subject": PACKAGES_KEEP_SUBJECT_RULES, "deletable_domain": DELETABLE_DOMAIN_RULES},
}
DEFAULT_PACK = "web"


def pack_rows(pack: str = DEFAULT_PACK) -> list[dict]:
    """Flat rule table of a pack: one dict per rule, in evaluation order."""
    rows = []
    for layer_no, layer in enumerate(LAYERS, start=1):
        for ord_, rule in enumerate(PACKS[pack][layer], start=1):
            if layer == "combo":
                pattern, pattern2, rid = rule
            else:
                (pattern, rid), pattern2 = rule, None
            rows.append({"pack": pack, "layer": layer, "layer_no": layer_no, "ord": ord_,
                         "decision": LAYER_DECISION[layer], "rule_id": rid,
                         "reason": REASON_PREFIX[layer] + rid,
                         "pattern": pattern, "pattern2": pattern2})
    return rows

# ---------------------------------------------------------------------------
# Four-class labeling outcomes (class, in training, target, reason)
# ---------------------------------------------------------------------------
LABEL_OUTCOMES = {
    "tx_in_trash": ("archival_after_handled", False, None, "trash+transactional ({rule}) — user cleanup, exclude"),
    "tx": ("transactional_keep", True, "keep", "transactional ({rule})"),
    "read_later_in_trash": ("deletable_now", True, "spam", "read_later + trash → treat as spam signal"),
    "read_later": ("read_later", False, None, "tematic newsletter — user reads selectively"),
    "spam": ("deletable_now", True, "spam", "trash-derived spam"),
    "default_keep": ("deletable_now", True, "keep", "default keep"),
}
# Sources that carry an explicit human or curated signal (training eligibility).
HUMAN_SOURCES = ["user_restore", "user_confirm"]
CURATED_PREFIX = "bootstrap_"
RECOVERY_DAYS = 30
