"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# --- fixed values: search stop words ---
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has",
    "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was",
    "were", "will", "with", "this", "have", "been", "they", "what", "when",
    "where", "which", "who", "how", "but", "not", "can", "if", "than", "then",
    "some", "more", "also", "into", "your", "our", "we", "their", "about",
]

# --- fixed values: BM25 ---
BM25_K1, BM25_B, BM25_EPSILON = 1.2, 0.75, 0.25

# --- fixed values: intent rules, in order of precedence ---
# the third analytics rule excludes questions that speak of "my" or "i"
INTENT_RULES = [
    ("TICKET_ANALYTICS", [
        r"\b(how\s+many|count\s+of|number\s+of|total\s+(?:number|count)?|how\s+much)\b[\w\s\-]{0,40}\b(tickets?|incidents?|requests?)\b",
        r"\b(tickets?|incidents?|requests?)\b[\w\s\-]{0,20}\b(count|total)\b",
    ]),
    ("TICKET_ANALYTICS_FOLLOW_UP", [
        r"^(what about|how about|and what about|also)\b[\w\s\-]{0,60}\b(open|closed|resolved|rejected|pending|in[\s\-]?progress|low|medium|high|critical)\b[\w\s\-]{0,40}\b(tickets?|incidents?|requests?)\b",
    ]),
    ("TICKET_LOOKUP", [
        r"\b(ticket|incident|INC|JIRA|issue|bug|request)\s*[#\-]?\d+",
        r"\b(look\s*up|find|show|get|fetch|retrieve)\s+(ticket|incident|issue|request)",
        r"\b(my\s+ticket|open\s+ticket|recent\s+ticket|ticket\s+status|pending\s+ticket)",
        r"\bstatus\s+of\s+(ticket|incident|request)",
        r"\b(my|any|open|recent|pending|all)\b[\w\s\-]{0,40}\b(ticket|tickets|incident|incidents|request|requests)\b",
        r"\b(ticket|tickets|incident|incidents|request|requests)\b[\w\s\-]{0,40}\b(status|update|progress|pending|open|resolved|closed)\b",
    ]),
    ("SUMMARIZE", [
        r"\b(summarize|summarise|summary|overview|brief|tl;?dr|abstract)\b",
        r"\bgive\s+me\s+(an?\s+)?(overview|summary|brief|synopsis)\b",
        r"\bwhat\s+(does|is|are)\s+.{3,60}\s+(about|cover|contain|explain)\b",
        r"\b(explain|describe)\s+(the\s+)?(whole|entire|full|complete)\b",
    ]),
    ("ESCALATE", [
        r"\b(escalate|raise|create|open|log|submit)\s+(a\s+|an\s+|new\s+)?(ticket|incident|issue|case)\b",
        r"\b(nobody|no\s+one|not\s+resolved|unresolved).{0,40}(help|respond|fix|solve)",
        r"\bneed\s+(human|agent|support|help)\s+(now|urgently|immediately)",
    ]),
    ("SMALLTALK", [
        r"^(hi|hello|hey|howdy|greetings|good\s+(morning|afternoon|evening))\b",
        r"^(how\s+are\s+you|what\s+can\s+you\s+do|who\s+are\s+you|what\s+are\s+you)\b",
        r"^(thank|thanks|bye|goodbye|see\s+you|cheers)\b",
    ]),
]
FIRST_PERSON = r"\b(my|i)\b"
INTENT_RULE_CONFIDENCE = 0.92

# --- fixed values: intent signals, in tie order ---
INTENT_SIGNALS = [
    ("TICKET_LOOKUP", ["incident", "outage", "broken", "error", "crash", "not working",
                       "failing", "bug", "defect", "cannot access", "blocked"]),
    ("SUMMARIZE", ["summary", "overview", "what is", "explain", "describe", "brief",
                   "key points", "main points", "highlights"]),
    ("SEARCH", ["how to", "steps to", "procedure for", "policy on", "guide to",
                "process for", "what is the", "where can i", "how do i"]),
    ("ESCALATE", ["urgent", "critical", "asap", "immediately", "still broken",
                  "nobody responding", "escalate", "raise ticket"]),
]

# --- fixed values: query expansion ---
EXPANSIONS = [
    ("vpn", ["vpn access", "remote access", "virtual private network"]),
    ("leave", ["annual leave", "leave policy", "time off request", "leave entitlement"]),
    ("password", ["password reset", "account access recovery", "credential reset"]),
    ("invoice", ["invoice processing", "invoice approval", "billing document"]),
    ("deploy", ["deployment process", "release pipeline", "ci/cd workflow"]),
    ("onboard", ["employee onboarding", "new hire process", "joining procedure"]),
    ("expense", ["expense claim", "expense reimbursement", "travel expense"]),
    ("access", ["access request", "permission grant", "role assignment"]),
    ("incident", ["incident response", "incident management", "outage handling"]),
    ("performance", ["performance review", "appraisal process", "annual evaluation"]),
    ("kubernetes", ["k8s cluster", "pod deployment", "container orchestration"]),
    ("docker", ["container build", "dockerfile", "image registry"]),
    ("monitoring", ["grafana dashboard", "prometheus alerts", "observability setup"]),
    ("database", ["database backup", "db performance", "query optimization"]),
    ("security", ["security policy", "access control", "vulnerability management"]),
    ("budget", ["budget approval", "budget allocation", "cost centre"]),
    ("training", ["employee training", "learning program", "skill development"]),
    ("offboard", ["employee offboarding", "exit process", "account deprovisioning"]),
]
REPOSITORY_EXPANSIONS = [
    ("vpn", ["vpn access", "remote access", "virtual private network", "vpn connection"]),
    ("leave", ["annual leave", "leave policy", "time off", "vacation days"]),
    ("password", ["password reset", "account access", "credential reset"]),
    ("invoice", ["invoice processing", "invoice approval", "billing document"]),
    ("deploy", ["deployment process", "release process", "ci/cd pipeline"]),
    ("onboard", ["employee onboarding", "new hire process", "joining process"]),
    ("expense", ["expense claim", "expense reimbursement", "travel expense"]),
    ("access", ["access request", "permission request", "role access"]),
    ("incident", ["incident response", "incident management", "outage handling"]),
    ("performance", ["performance review", "appraisal process", "evaluation"]),
]

# --- fixed values: decomposition ---
CONJUNCTIONS = r"\b(and also|as well as|additionally|furthermore|along with)\b"
COMPARISONS = r"\b(difference between|compare|versus|vs\.?)\b"

# --- fixed values: repository and department preference words and weights ---
REPOSITORY_WORDS = [
    ("Policies", ["policy", "policies", "pto", "leave", "code of conduct", "compliance", "guideline", "handbook"]),
    ("Tickets", ["ticket", "incident", "INC", "issue", "outage"]),
    ("Engineering", ["deploy", "kubernetes", "docker", "ci/cd", "pipeline", "database", "api", "monitoring",
                     "infrastructure"]),
    ("Finance", ["invoice", "budget", "expense", "reimbursement", "cost centre"]),
    ("HR", ["onboard", "offboard", "performance review", "appraisal", "training", "leave", "pto", "hr policy"]),
    ("IT", ["vpn", "password", "access request", "account", "software install"]),
]
DEPARTMENT_WORDS = [
    ("HR", ["leave", "pto", "onboarding", "offboarding", "performance review", "appraisal", "training", "hr policy",
            "employee"]),
    ("Finance", ["invoice", "budget", "expense", "reimbursement", "payroll", "cost centre"]),
    ("IT", ["vpn", "password", "access request", "account", "network", "software"]),
    ("Engineering", ["deploy", "kubernetes", "docker", "pipeline", "database", "monitoring"]),
]
REPOSITORY_WEIGHT, DEPARTMENT_WEIGHT = 0.20, 0.15

# --- fixed values: repository routing ---
ROUTING_WORDS = [
    ("HR", ["leave", "annual leave", "sick leave", "vacation", "payroll", "salary", "onboarding", "offboarding", "hiring",
            "recruit", "employee", "benefits", "performance review", "appraisal", "training", "handbook", "grievance",
            "resignation", "notice period", "carry forward", "maternity", "paternity"]),
    ("Finance", ["invoice", "budget", "expense", "reimbursement", "payment", "tax", "purchase order", "po",
                 "accounts payable", "accounts receivable", "financial", "billing", "cost", "vendor payment", "audit",
                 "fiscal", "travel claim", "allowance", "procurement"]),
    ("IT", ["vpn", "network", "firewall", "dns", "dhcp", "wifi", "internet", "laptop", "printer", "server", "access",
            "password", "reset", "ticket", "incident", "outage", "troubleshoot", "install", "software", "hardware",
            "antivirus", "email", "outlook", "teams", "remote"]),
    ("Engineering", ["kubernetes", "docker", "k8s", "deploy", "deployment", "pipeline", "cicd", "ci/cd", "gitlab",
                     "github", "git", "api", "microservice", "kafka", "redis", "postgres", "database", "monitoring",
                     "grafana", "prometheus", "terraform", "ansible", "databricks", "airflow", "architecture",
                     "backend", "frontend", "devops", "infrastructure"]),
    ("Projects", ["project", "milestone", "sprint", "scrum", "agile", "roadmap", "stakeholder", "delivery", "timeline",
                  "risk", "dependency", "kickoff", "status update", "project plan", "charter"]),
    ("External", ["documentation", "public docs", "vendor", "third party", "kubernetes docs", "gitlab handbook",
                  "docker docs"]),
]
DEPARTMENT_REPOSITORY = {
    "HR": "HR", "Finance": "Finance", "IT": "IT", "Engineering": "Engineering", "Projects": "Projects",
    "Operations": "IT",
}

# --- fixed values: file-name classification, in order ---
DEPARTMENT_RULES = [
    (r"(hr|human.?resource|leave|payroll|onboard)", "HR"),
    (r"(finance|budget|invoice|expense|account)", "Finance"),
    (r"(it|network|infra|devops|deploy|kubernetes|docker)", "IT"),
    (r"(engineer|architecture|system.?design|api|backend)", "Engineering"),
    (r"(project|milestone|roadmap|sprint|scrum)", "Projects"),
    (r"(gitlab|handbook|policy|guide|customer)", "Operations"),
]
DOC_TYPE_RULES = [
    (r"(sop|standard.?operating)", "SOP"),
    (r"(policy|policies)", "Policy"),
    (r"(runbook|playbook|incident.?response)", "Runbook"),
    (r"(guide|how.?to|tutorial|getting.?started)", "Guide"),
    (r"(presentation|slides|deck)", "Presentation"),
    (r"(handbook|wiki)", "Guide"),
    (r"(ticket|incident|issue)", "Ticket"),
]

# --- fixed values: heading shapes ---
HEADING_UNIVERSAL = (r"^(#{1,6}\s+.+|\d+(\.\d+)*\.?\s+.+|[A-Z][A-Z\s\-/&,]{3,80}"
                     r"|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,6})$")
HEADING_POLICY = r"^(?:[A-Z][A-Z\s&/,]{3,50}|#{1,3}\s+.+|\d+\.\s+[A-Z].+)$"
STEP_HEADER = r"^(?:Step\s*\d+|\d+[.)]\s+|#{1,3}\s+)"
HEADING_MARKDOWN = r"^(#{1,6})\s+(.+)$"
HEADING_NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(.+)$"

# --- fixed values: personal data, in order of replacement: type, token prefix, pattern ---
PII_PATTERNS = [
    ("email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("employee_id", "EMP", r"(?i)\b(?:EMP|EMPID|EMPLOYEE|STAFF|EID)[-_]?\d{3,8}\b"),
    ("pan_india", "PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", "CARD", r"\b\d(?:[ -]?\d){12,15}\b"),
    ("aadhaar", "AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("ip_address", "IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("phone", "PHONE", r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3,4}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"),
]
PARITY_CARD_PATTERN = r"\b(?:\d[ -]?){13,16}\b"
TECHNICAL_TYPES = ["ip_address", "phone"]
TECHNICAL_DEPARTMENTS = ["IT", "Engineering"]
TECHNICAL_DOC_TYPES = ["Runbook"]
QUERY_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
QUERY_PHONE = r"\b(?:\+\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4,6}\b"
TICKET_ID = r"\b([A-Z]{2,8}-\d+|INC\d{4,}|REQ\d+|[A-Z]{2,8}\d{4,})\b"

# --- fixed values: vague words and ranking constants ---
VAGUE_WORDS = [
    "it", "this", "that", "these", "those", "they", "them", "there", "here", "one", "ones", "thing", "stuff", "such",
    "same", "above", "below", "previous", "former", "latter", "again", "also", "too",
]
TIER_RRF_BOOST = {1: 1.30, 2: 1.15, 3: 1.00, 4: 0.85}
TIER_ADDITIVE = {1: 0.05, 2: 0.02, 3: 0.00, 4: -0.05}
SOURCE_MULTIPLIER = {"bm25": 1.15}
RRF_K = 60
BOOST_DEPARTMENT, BOOST_REPOSITORY, BOOST_TERM, BOOST_TICKET, BOOST_CAP = 0.08, 0.12, 0.10, 0.25, 0.30
FINAL_THRESHOLD, LOW_CONFIDENCE = 0.38, 0.35
INTERNAL_TOP_K, INTERNAL_MIN_COSINE, INTERNAL_MIN_RESULTS = 15, 0.70, 3
STALE_DAYS = 180

# --- fixed values: tickets ---
TICKET_HEADERS = {
    "id": ["id", "ticket_id", "ticketid", "ticket id"],
    "subject": ["subject", "title", "summary"],
    "description": ["description", "details", "body"],
    "priority": ["priority", "severity"],
    "category": ["category", "type", "issue_type"],
    "created_at": ["createdat", "created_at", "created", "date", "opened_at"],
    "requester_email": ["requesteremail", "requester_email", "email", "raised_by"],
    "status": ["status", "ticket_status", "state"],
    "resolution": ["resolution", "resolution_notes", "resolution_text", "fix"],
    "resolved_at": ["resolvedat", "resolved_at", "closed_at", "resolution_date"],
}
STATUS_WORDS = {
    "open": "open", "new": "open", "unresolved": "open", "pending": "open",
    "in progress": "in_progress", "in_progress": "in_progress", "in-progress": "in_progress",
    "working": "in_progress", "assigned": "in_progress",
    "resolved": "resolved", "fixed": "resolved", "done": "resolved",
    "closed": "closed", "completed": "closed",
}
CATEGORY_DEPARTMENT = {
    "Network": "IT", "Hardware": "IT", "Software": "IT", "Access": "IT", "Email": "IT", "Security": "IT",
    "HR": "HR", "Payroll": "HR", "Leave": "HR", "Finance": "Finance", "Billing": "Finance",
}
FILTER_STATUS = [
    ("in progress", "in_progress"), ("in-progress", "in_progress"), ("unresolved", "open"), ("resolved", "resolved"),
    ("rejected", "rejected"), ("pending", "open"), ("closed", "closed"), ("open", "open"),
]
FILTER_PRIORITY = [("low", "Low"), ("medium", "Medium"), ("high", "High"), ("critical", "Critical")]
FILTER_CATEGORY = [("hr", "HR"), ("finance", "Finance"), ("it", "IT"), ("engineering", "Engineering"),
                   ("operations", "Operations"), ("security", "Security")]
SYMPTOM_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "i", "my", "our", "can", "cant", "cannot", "not", "have", "has",
    "been", "for", "with", "about", "when", "how", "what", "why", "where", "please", "help", "issue", "problem", "error",
]

# --- fixed values: ingestion ---
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".pptx"]
DEFAULT_ROLES = ["EMPLOYEE", "MANAGER", "HR", "FINANCE", "IT_ADMIN", "EXECUTIVE"]
STAGE_PROGRESS = [
    ("queued", 0), ("saving_upload", 5), ("parsing_document", 15), ("classifying", 20), ("chunking", 35),
    ("enriching_chunks", 55), ("extracting_images", 70), ("redacting_pii", 80), ("indexing", 92), ("finalizing", 98),
    ("completed", 100),
]
