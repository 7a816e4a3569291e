"""Word lists, tag sets, label sets and settings that results depend on."""

# --- decisions and their labels (class order is the listed order) --------------------------------
DECISION_LABELS = {
    "turn_complete": ("false", "true"),
    "barge_in": ("backchannel", "interruption", "noise"),
    "route": (
        "transfer", "transactions", "balance", "freeze_account", "pay_bill", "bill_balance",
        "bill_due", "interest_rate", "routing", "min_payment", "order_checks", "pin_change",
        "report_fraud", "account_blocked", "spending_history", "out_of_scope",
    ),
    "escalate": ("false", "true"),
}
EVENT_QUESTIONS = {
    "user_pause": ("turn_complete", "route", "escalate"),
    "user_speech_during_agent": ("barge_in", "escalate"),
}
OUT_OF_SCOPE = "out_of_scope"
QUESTION_TEXT = {
    "turn_complete": "Has the user finished their turn and is now waiting for a reply?",
    "barge_in": "The user spoke while the agent was talking. What was it?",
    "route": "Which banking request is the user making?",
    "escalate": "Should this conversation be handed to a human?",
}
OPTION_TEXT = {
    "turn_complete": (
        "the user is mid-thought and will keep talking",
        "the user has finished and expects the agent to respond",
    ),
    "barge_in": (
        "brief listener feedback that does not claim the turn, like uh-huh or right",
        "the user wants the floor: a question, objection, correction or new request",
        "not speech to the agent: a fragment, laughter, or talk to someone else",
    ),
    "route": (
        "move money between accounts", "details of a past transaction",
        "how much is in an account", "the user wants an account frozen", "pay a bill",
        "how much a bill owes", "when a bill is due", "an account's interest rate",
        "the bank's routing number", "the minimum payment due", "order new checks",
        "change a PIN", "report fraud or a charge they did not make",
        "why an account was blocked", "how much was spent over time",
        "anything a bank support agent does not handle",
    ),
    "escalate": (
        "the user is fine continuing with the automated agent",
        "the user asks for a person, or is frustrated and not being helped",
    ),
}

# --- act tags ------------------------------------------------------------------------------------
WHOLE_TAGS = ("qy^d", "qw^d", "b^m")
RENAMED_TAGS = {"nn^e": "ng", "ny^e": "na"}
MERGED_TAGS = {
    "qr": "qy", "fe": "ba", "oo": "oo_co_cc", "co": "oo_co_cc", "cc": "oo_co_cc", "fx": "sv",
    "aap": "aap_am", "am": "aap_am", "arp": "arp_nd", "nd": "arp_nd",
    "fo": 'fo_o_fw_"_by_bc', "o": 'fo_o_fw_"_by_bc', "fw": 'fo_o_fw_"_by_bc',
    '"': 'fo_o_fw_"_by_bc', "by": 'fo_o_fw_"_by_bc', "bc": 'fo_o_fw_"_by_bc',
}
CONTINUATION_TAG = "+"
BACKCHANNEL_TAGS = ("b", "bh")
NOISE_TAGS = ("x", "%")
INTERRUPTION_TAGS = (
    "sd", "sv", "qy", "qw", "qo", "qh", "qrr", "qy^d", "qw^d", "ad", "ar", "arp_nd", "ng", "nn",
)
MINIMAL_RESPONSE_TAGS = ("aa", "bk", "ba", "na", "ny", "b^m")

# --- message rules -------------------------------------------------------------------------------
BANK_BRANDS = (
    "BofA_Help", "AskAmex", "AskPayPal", "ChaseSupport", "Ask_WellsFargo", "AskCiti", "askvisa",
    "KeyBank_Help",
)
ESCALATION_CUES = (
    r"\b(human|real person|a person|representative|supervisor|manager|someone|anyone|"
    r"call me|speak to|speak with|talk to|escalat\w*|complain\w*|ridiculous|unacceptable|"
    r"terrible|worst|awful|useless|horrible|frustrat\w*|angry|upset|again|still|third|"
    r"several times|no one|nobody|never|close my account|cancel\w*|lawyer|cfpb|bbb)\b|!!"
)
ENGLISH_WORDS = (
    "the an i you it is to and of my me for in on not this that have was with your can why what "
    "how do does did but just we are be"
).split()
OTHER_LANGUAGE_WORDS = (
    "de la que el en los las por para una un mi se es con del le les et je pas est il y o da em "
    "um uma voce nao che di il per non"
).split()
AGENT_OPENERS = (
    "how can i help you today", "what can i do for you",
    "is there anything else i can help you with", "sure what do you need", "",
)
FILLER_WORDS = ("um", "uh", "er", "ah")
BACKCHANNEL_WORDS = (
    "uh", "huh", "mhm", "hm", "hmm", "mm", "yeah", "yep", "yes", "right", "okay", "ok", "oh",
    "sure", "really", "wow", "i", "see", "true", "exactly",
)
STRATA = ("cue/reply", "cue/opener", "plain/reply", "plain/opener")

# --- secret patterns -----------------------------------------------------------------------------
SECRET_RULES = {
    "router_key": r"sk-or-v1-[0-9a-f]{20,}",
    "assistant_key": r"sk-ant-[A-Za-z0-9_-]{20,}",
    "inference_key": r"gsk_[A-Za-z0-9]{40,}",
    "hub_key": r"hf_[A-Za-z0-9]{30,}",
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "env_line": r"(?m)^[A-Z][A-Z0-9_]*(KEY|TOKEN|SECRET)[A-Z0-9_]*\s*=\s*\S{8,}",
}
SECRET_NAME = r"(?i)(^\.env|^kaggle\.json$|^id_(rsa|ed25519)|credentials|\.(pem|key|p12|pfx)$)"

# --- label rules ---------------------------------------------------------------------------------
GUIDELINE_LABELS = {"v1": ("true", "false", "skip"), "v2": ("true", "false")}
MACHINE_TO_BOOL = {"escalate": "true", "no": "false", "y": "true", "n": "false"}

# --- settings ------------------------------------------------------------------------------------
SPLIT_SEED = 20260927
SPLIT_FRACTIONS = (("train", 0.70), ("calib", 0.10), ("test", 0.20))
MAX_HISTORY_TURNS = 8
MINIMAL_MAX_WORDS = 3
PARTIAL_WORDS = 12
SHARED_FORM_MIN_COUNT = 20
SHARED_FORM_MIN_SHARE = 0.2
TURN_FINAL_MIN_COUNT = 10
MESSAGE_MIN_WORDS, MESSAGE_MAX_WORDS = 3, 60
ANCESTOR_DEPTH = 32
RELABEL_SEED = 20260928
TRAIN_SAMPLE_SEED = 20260929
ECE_BINS = 15
TEMPERATURE_BOUNDS = (0.25, 10.0)
MIN_BIN_DISPLAY = 20
BOOTSTRAP_SAMPLES = 10_000
BOOTSTRAP_SEED = 20260927
WARMUP_CALLS = 50
MAX_ATTEMPTS = 3
ABORT_TEMP_C = 85.0
AGREEMENT_BAR = 0.995
P99_BUDGET_MS = {"cuda": 50.0, "cpu": 100.0}
DEV_FRACTION = 0.05
SPEND_CAP_USD, SPEND_MARGIN = 5.0, 0.95
KAPPA_BAR, PRECISION_BAR = 0.60, 0.70
VAD_PAUSE_MS, MAX_WAIT_MS = 300, 2000
TARGET_FALSE_STOP, TARGET_PREMATURE = 0.05, 0.05
NAIVE_SILENCE_MS, BARGE_WINDOW_MS = 800, 600
SAFETY_MARGIN = 8
THETA_INTERRUPT, THETA_YIELD, THETA_ESCALATE, THETA_OOS = 0.09, 0.785, 0.505, 0.45
NOISE_LEVELS = (0.0, 0.05, 0.1, 0.2)
NOISE_VOCAB = 5000
GRID_POINTS = 201
Z95 = 1.96
TELEMETRY_FIELDS = (
    "timestamp", "temperature_gpu", "clocks_sm", "clocks_mem", "clocks_max_sm", "power_draw",
    "power_limit", "pstate", "events_active", "sw_power_cap", "hw_slowdown",
    "hw_thermal_slowdown", "sw_thermal_slowdown", "hw_power_brake_slowdown",
)
TELEMETRY_NUMERIC = (
    "temperature_gpu", "clocks_sm", "clocks_mem", "clocks_max_sm", "power_draw", "power_limit",
)
THROTTLE_FLAGS = (
    "hw_slowdown", "hw_thermal_slowdown", "sw_thermal_slowdown", "hw_power_brake_slowdown",
)
