"""Fixed values. These word lists, patterns, tables and thresholds define the results, so they
are stated here as plain text and used everywhere else by name."""

# --- support desk vocabulary -------------------------------------------------
CATEGORIES = ["billing", "shipping", "technical", "account", "returns"]
PRIORITIES = ["low", "medium", "high", "urgent"]
TIERS = ["standard", "silver", "gold"]
SLA_HOURS = {"urgent": 8, "high": 24, "medium": 48, "low": 120}
LOW_CSAT = 2
TOP_CONTACTS = 10
DEFAULT_TIER = "standard"
DEFAULT_CHANNEL = "chat"

# --- personal data: label -> pattern, in the order of replacement -------------
PII_PATTERNS = {
    "EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "CNPJ": r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b",
    "CPF": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    "CARD": r"\b(?:\d[ -]?){13,16}\b",
    "PHONE": r"(?:\+?55\s?)?\(?\d{2}\)?\s?9?\d{4}-?\d{4}\b",
}
ORDER_NUMBER = r"\b\d{5}\b"
ORDER_NUMBER_TOKEN = " num_pedido "
ORDER_ID = r"\b(1\d{4})\b"

# --- input guard --------------------------------------------------------------
MAX_INPUT_CHARS = 4000
INJECTION_PATTERNS = [
    r"ignore (all |the )?(previous|prior|above) (instructions|prompts?)",
    r"ignore (as |todas as )?instru[cç][oõ]es anteriores",
    r"desconsidere (as )?instru[cç][oõ]es",
    r"you are now",
    r"voc[eê] agora [eé]",
    r"system prompt",
    r"prompt do sistema",
    r"reveal (your|the) (instructions|prompt|secrets?)",
    r"act as (an? )?(admin|developer|dba)",
    r"\b(drop|truncate)\s+table\b",
]
REFUSAL = (
    "Não posso processar esta solicitação por motivos de segurança ({reason}). "
    "Um atendente humano pode ajudar."
)

# --- guard for generated SQL ----------------------------------------------------
ALLOWED_RELATIONS = ["orders", "tickets", "v_customer_safe"]
MAX_LIMIT = 100
DISPLAY_LIMIT = 50
FORBIDDEN_SQL = [
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke",
    "attach", "detach", "pragma", "replace", "merge", "copy", "vacuum", "exec", "execute", "call",
]

# --- question routing -------------------------------------------------------------
STOPWORDS = [
    "a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "é", "em", "um", "uma", "para",
    "por", "com", "no", "na", "nos", "nas", "que", "qual", "quais", "meu", "minha", "meus",
    "minhas", "se", "eu", "voce", "vocês", "voces", "como", "quando", "quanto", "quantos",
    "quantas", "ao", "à", "mais", "ou", "já", "ja", "tem", "ter", "foi", "ser", "está", "esta",
    "isso", "esse", "essa", "sobre", "posso", "pode", "consigo",
]
ANALYTICS_KEYWORDS = [
    (["sla", "prazo de resolucao", "estouro", "violacao"], "sla_breaches_by_priority"),
    (["transportadora", "atraso", "atrasos", "entrega"], "carrier_delay_ranking"),
    (["mes", "mensal", "evolucao", "crescimento", "tendencia"], "monthly_volume"),
    (["csat", "satisfacao", "canal", "canais"], "csat_by_channel"),
    (["recorrente", "reincidente", "mais chamados", "clientes que mais"],
     "top_contacting_customers"),
    (["categoria", "categorias", "volume", "tickets", "chamados"], "tickets_by_category"),
]
ANALYTICS_HINTS = [
    "quantos", "quantas", "taxa", "media", "percentual", "ranking", "volume", "por categoria",
    "por canal", "por prioridade", "por mes", "csat", "sla", "tendencia", "evolucao",
    "transportadora com", "mais atras", "relatorio",
]

# --- retrieval and answers ----------------------------------------------------------
CHUNK_CHARS = 1200
CHUNK_OVERLAP = 150
RRF_K = 60
CANDIDATES = 10
ANSWER_CHUNKS = 4
LSA_DIMS = 192
BOOST_MIN_CONFIDENCE = 0.75
CATEGORY_SOURCES = {
    "billing": ["politica-de-reembolso.md", "pagamentos-e-parcelamento.md"],
    "shipping": ["prazos-e-entregas.md"],
    "technical": ["suporte-tecnico-app.md"],
    "account": ["conta-e-seguranca.md", "lgpd-e-privacidade.md"],
    "returns": ["politica-de-trocas-e-devolucoes.md"],
}
LATE_ORDER_HINT = " atraso entrega"
ORDER_HINT = " pedido "
STATUS_LABELS = {
    "delivered": "entregue",
    "shipped": "em transporte",
    "processing": "processando",
    "cancelled": "cancelado",
    "returned": "devolvido",
}
NO_ANSWER = (
    "Não encontrei essa informação na base de conhecimento. "
    "Vou encaminhar para um atendente humano."
)
TYPOGRAPHY = {"‑": "-", "‐": "-", "【": "[", "】": "]"}

# --- incident detection -----------------------------------------------------------------
BASELINE_DAYS = 28
BASELINE_MIN_DAYS = 7
MAD_TO_SIGMA = 1.4826
Z_THRESHOLD = 3.5
FOREST_TREES = 300
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.03

# --- models and monitoring -----------------------------------------------------------------
TEST_FRACTION = 0.2
AUTO_ROUTE_THRESHOLD = 0.6
NB_SMOOTHING = 0.3
CV_FOLDS = 5
CHAR_FEATURES = 40000
PSI_FLOOR = 1e-4
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25
DRIFT_WINDOW = 1000
DRIFT_MIN_SAMPLES = 50
RATE_WINDOW_SECONDS = 60
RATE_LIMIT = 120
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
QUALITY_GATES = {
    "category_macro_f1": 0.85,
    "urgent_recall": 0.75,
    "incident_f1": 0.70,
    "retrieval_hit@3": 0.85,
    "agent_routing_accuracy": 0.85,
    "answer_grounding": 0.60,
    "security_pass_rate": 1.0,
}
