"""Word lists, weights and tables the results depend on. All can be overridden by argument."""

# Namespace prefixes that mark a predicate-like id or label.
PREDICATE_PREFIXES_ID = ["ns0__", "ns2__", "rdfs__", "owl__", "rdf__"]
PREDICATE_PREFIXES_LABEL = ["ns0__", "rdfs__", "owl__"]

# Hints for solution-like entities.
ENTITY_HINTS = ["solution", "implement", "system", "technology", "api", "framework"]

# Terms for metrics (actionability, coherence, domain, technology).
ACTION_VERBS = [
    "implement", "create", "develop", "build", "design", "configure", "setup", "install", "deploy", "integrate",
    "connect", "establish", "enable", "activate", "initialize", "execute", "run", "start", "launch", "test",
    "validate", "verify", "monitor",
]
VAGUE_TERMS = [
    "somehow", "maybe", "probably", "might", "could", "should consider", "try to", "attempt to", "think about",
    "look into", "explore",
]
CONCRETE_TERMS = [
    "using", "with", "via", "through", "by implementing", "by configuring", "tool", "library", "framework",
    "platform", "service", "software",
]
# fixed values; the patterns are counted literally, as text
SEQUENCE_TERMS = [
    r"step\s+\d+", r"instruction\s+\d+", r"\d+\.", r"\d+\)",
    "first", "second", "third", "then", "next", "after", "before", "finally", "initially", "subsequently",
    "meanwhile", "once", "when", "while", "therefore", "thus", "hence", "consequently", "as a result", "because",
    "since", "given that", "provided that", "assuming", "if", "unless", "furthermore", "moreover", "additionally",
    "also", "in addition", "building on", "expanding", "extending",
]
STEP_PATTERNS = [r"step\s+\d+", r"instruction\s+\d+", r"\d+\.", r"\d+\)", "first", "second", "third", "fourth", "fifth"]
DEPENDENCY_WORDS = ["after", "before", "once", "when", "then", "next", "following"]
GENERIC_TERMS = [
    "system", "solution", "approach", "method", "way", "process", "thing", "item", "element", "component", "part",
    "aspect",
]
DOMAIN_TERMS = {
    "healthcare": ["patient", "medical", "clinical", "diagnosis", "treatment", "therapy", "hospital", "doctor",
                   "nurse", "medication", "prescription", "healthcare", "disease", "symptom", "vital", "health",
                   "care", "medical record"],
    "business": ["customer", "market", "revenue", "profit", "sales", "marketing", "strategy", "business", "company",
                 "enterprise", "stakeholder", "roi", "kpi", "budget", "investment", "growth", "competition", "brand"],
    "technology": ["api", "database", "system", "software", "application", "platform", "server", "cloud", "network",
                   "security", "algorithm", "code", "programming", "development", "tech", "digital", "computing"],
    "finance": ["financial", "investment", "portfolio", "trading", "banking", "credit", "loan", "interest", "capital",
                "asset", "liability", "risk", "return", "market", "stock", "bond", "funds", "money"],
    "education": ["student", "teacher", "learning", "education", "curriculum", "course", "training", "knowledge",
                  "skill", "academic", "school", "university", "assessment", "grade", "study", "research"],
    "manufacturing": ["production", "manufacturing", "assembly", "quality", "process", "factory", "equipment",
                      "supply chain", "inventory", "logistics", "operations", "efficiency", "automation",
                      "maintenance"],
}
TECHNICAL_TERMS = [
    "implement", "develop", "code", "program", "script", "function", "class", "method", "library", "framework",
    "module", "package", "import", "install", "configure", "server", "database", "api", "endpoint", "url", "http",
    "https", "rest", "json", "xml", "sql", "nosql", "mongodb", "mysql", "postgresql", "redis", "cache", "aws",
    "azure", "gcp", "cloud", "docker", "kubernetes", "container", "deploy", "deployment", "ci/cd", "devops",
    "infrastructure", "microservices", "serverless", "algorithm", "model", "machine learning", "ai",
    "artificial intelligence", "neural", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy", "data",
    "dataset", "python", "javascript", "java", "c++", "react", "angular", "vue", "node.js", "spring", "django",
    "flask", "fastapi", "git", "github", "gitlab", "jenkins",
]
SPECIFIC_TOOLS = [
    "python", "javascript", "java", "c++", "c#", "go", "rust", "php", "ruby", "react", "angular", "vue", "django",
    "flask", "spring", "tensorflow", "pytorch", "pandas", "numpy", "opencv", "keras", "scikit-learn", "mysql",
    "postgresql", "mongodb", "redis", "elasticsearch", "cassandra", "aws", "azure", "gcp", "docker", "kubernetes",
    "jenkins", "github", "gitlab", "rest", "graphql", "soap", "http", "https", "json", "xml", "oauth", "salesforce",
    "shopify", "wordpress", "stripe", "twilio", "slack", "zoom",
]
IMPLEMENTATION_TERMS = [
    "configure", "setup", "install", "initialize", "authenticate", "connect to", "endpoint", "url", "port",
    "parameter", "variable", "function", "method", "class", "object", "instance", "callback", "webhook", "token",
    "key",
]
CODE_TERMS = [
    "code", "script", "config", "configuration", "yaml", "json", "xml", "environment variable", "command line",
    "terminal", "bash", "shell", "import", "require", "include", "library", "package", "dependency",
]

# Understandability and user focus.
LINE_VERBS = ["create", "build", "install", "configure", "set", "run", "execute", "open", "click", "enter", "select", "save"]
CONCRETE_NOUNS = ["file", "folder", "button", "menu", "screen", "field", "option"]
JARGON = ["algorithm", "framework", "architecture", "implementation", "configuration", "optimization", "paradigm", "methodology"]
INTENT_WORDS = [
    "create", "build", "develop", "implement", "design", "setup", "configure", "analyze", "evaluate", "assess",
    "review", "examine", "integrate", "connect", "link", "combine", "merge", "optimize", "improve", "enhance",
    "upgrade", "automate", "streamline", "simplify",
]
REQUIREMENT_WORDS = ["should", "must", "need", "require", "want", "expect"]
NAMED_TERMS = ["API", "SDK", "ML", "AI", "IoT", "REST", "JSON", "XML", "SQL", "AWS", "Azure", "GCP"]

# Simple instruction metrics.
SIMPLE_TECH_TERMS = [
    "api", "database", "framework", "algorithm", "python", "javascript", "system", "interface", "model", "cloud",
    "server", "client", "docker", "machine learning", "ai", "analytics", "neural", "transform",
]
SIMPLE_ACTION_VERBS = [
    "implement", "create", "develop", "build", "establish", "design", "configure", "set up", "deploy", "integrate",
    "incorporate", "analyze", "measure", "test", "validate",
]
SIMPLE_DOMAINS = ["health", "finance", "education", "legal", "retail", "agriculture", "energy", "logistics", "security", "manufacturing"]
SIMPLE_WEIGHTS = {
    "user_focus": 0.25, "technological_specificity": 0.15, "actionability": 0.2, "coherence": 0.15,
    "semantic_similarity": 0.1, "domain_specificity": 0.15,
}
OVERALL_WEIGHTS = {
    "actionability": 0.10, "coherence": 0.30, "technological_specificity": 0.20, "domain_specificity": 0.10,
    "understandability": 0.15, "user_focus": 0.15,
}
TRANSITION_WORDS = [
    "however", "therefore", "furthermore", "moreover", "consequently", "additionally", "meanwhile", "nevertheless",
    "thus", "hence", "first", "second", "finally", "then", "next", "also", "because",
]
CLAUSE_WORDS = ["and", "or", "but", "that", "which", "who", "because", "although", "if", "when", "while", "since"]

# Ordered keyword groups of the coarse domain of a prompt.
DOMAIN_KEYWORDS = [
    ("healthcare", ["health", "medical", "patient", "clinical"]),
    ("business", ["business", "market", "customer", "revenue"]),
    ("technology", ["data", "analytics", "machine learning", "ai"]),
    ("finance", ["finance", "financial", "investment", "trading"]),
    ("education", ["education", "learning", "student", "teacher"]),
    ("manufacturing", ["manufacturing", "production", "factory"]),
]

# Ordered keyword groups of an entity's layer.
LAYER_KEYWORDS_LONG = [
    ("technology", ["api", "framework", "library", "algorithm", "protocol", "software", "application", "service",
                    "platform", "tool", "implementation", "ai", "machine learning", "neural network"]),
    ("data", ["data", "database", "table", "record", "field", "schema", "dataset", "storage", "warehouse", "pipeline"]),
    ("system", ["system", "module", "component", "process", "workflow", "interface", "architecture", "infrastructure"]),
    ("business", ["business", "customer", "user", "stakeholder", "requirement", "goal", "value", "market", "strategy", "objective"]),
]
LAYER_KEYWORDS_SHORT = [
    ("technology", ["api", "framework", "library", "algorithm", "software", "service", "platform", "tool", "ai", "machine learning"]),
    ("data", ["data", "database", "table", "schema", "dataset"]),
    ("system", ["system", "module", "component", "process", "interface"]),
    ("business", ["business", "customer", "user", "requirement", "goal"]),
]

LAYER_KEYWORDS_PATH = [
    ("technology", ["api", "software", "algorithm"]),
    ("data", ["data", "database"]),
    ("system", ["system", "process"]),
]  # everything else: business
LAYER_KEYWORDS_VIEW = [("data", ["data"]), ("system", ["system"]), ("business", ["business"]), ("technology", ["technology"])]  # else: other

# Suggestion terms of the selectable options.
OPTION_TERMS = {
    "Deep Learning": "deep learning", "Machine Learning": "machine learning",
    "Statistical Learning": "statistical learning", "Classification_nonlinear": "classifier",
    "Regression": "regression", "Decentralized": "decentralized", "Centralized": "centralized",
}

# Phrases that together mark a stand-in generation.
FALLBACK_PHRASES = ["graph-based data structure", "visualization tools", "algorithms to analyze"]

# Path scoring tables.
RELATION_QUALITY = [("implements", 1.0), ("enables", 1.0), ("solves", 1.0), ("addresses", 0.9), ("supports", 0.8),
                    ("uses", 0.7), ("contains", 0.6), ("applies", 0.5)]
ACTION_QUALITY = [("implements", 2.5), ("enables", 2.5), ("solves", 3.0), ("addresses", 2.0), ("uses", 1.5),
                  ("contains", 1.5), ("applies", 1.0), ("supports", 1.0)]
TWO_LEVEL_QUALITY = [("implements", 2.0), ("enables", 2.0), ("solves", 2.0), ("uses", 1.0), ("contains", 1.0)]
START_LAYER_BONUS = {"system": 2.0, "data": 1.5, "business": 1.0, "technology": 0.5}
PROGRESSION_MATRIX = {
    ("business", "system"): 3.0, ("business", "data"): 2.0, ("business", "technology"): 1.0,
    ("system", "data"): 3.0, ("system", "technology"): 2.0, ("system", "business"): 0.5,
    ("data", "technology"): 3.0, ("data", "system"): 1.0, ("data", "business"): 0.5,
    ("technology", "technology"): 1.5, ("technology", "data"): 1.0,
}
PROGRESSION_VALUES = {
    ("business", "system"): 1.0, ("system", "data"): 1.0, ("data", "technology"): 1.0,
    ("business", "data"): 0.7, ("system", "technology"): 0.7, ("business", "technology"): 0.5,
}
BRIDGE_VALUES = {
    ("business", "system"): 1.5, ("system", "data"): 1.5, ("data", "technology"): 1.5,
    ("business", "data"): 1.0, ("system", "technology"): 1.0,
}
CONNECTION_TERMS = ["tech", "technology", "api", "system", "data", "algorithm", "cloud", "device", "model", "ai",
                    "learning", "neural", "business", "service", "workflow"]

# Terms that make a generated triple too generic.
GENERIC_ENTITIES = ["this innovative solution", "groundbreaking opportunity", "solution", "opportunity"]

# Columns of the evaluation table, in order.
EVAL_COLUMNS = [
    "timestamp", "domain", "title", "prompt", "prompt_token_count", "dominant_domain", "gnn_instructions",
    "mcts_instructions", "rmodel_instructions", "gnn_actionability", "gnn_coherence", "gnn_domain_specificity",
    "gnn_technological_specificity", "mcts_actionability", "mcts_coherence", "mcts_domain_specificity",
    "mcts_technological_specificity", "rmodel_actionability", "rmodel_coherence", "rmodel_domain_specificity",
    "rmodel_technological_specificity", "gnn_overall_score", "mcts_overall_score", "rmodel_overall_score",
    "best_performing_model", "performance_gap", "gnn_node_count", "gnn_edge_count", "gnn_graph_density",
    "gnn_clustering_coefficient", "mcts_node_count", "mcts_edge_count", "mcts_graph_density",
    "mcts_clustering_coefficient", "gnn_graph_performance_ratio", "mcts_graph_performance_ratio",
    "graph_size_difference", "selected_gnn_subgraph", "selected_mcts_subgraph", "mcts_uses_combined_graph",
    "gnn_understandability_enhanced", "gnn_user_focus_enhanced", "mcts_understandability_enhanced",
    "mcts_user_focus_enhanced", "rmodel_understandability_enhanced", "rmodel_user_focus_enhanced",
    "gnn_understandability_normalized", "gnn_user_focus_normalized", "mcts_understandability_normalized",
    "mcts_user_focus_normalized", "rmodel_understandability_normalized", "rmodel_user_focus_normalized",
]

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()

SUBGRAPH_PRIORITY = {
    "gnn": ["gnn", "combined_subgraph", "llm"],
    "mcts": ["combined_subgraph", "mcts_reasoning_path", "traversal"],
    "default": ["combined_subgraph"],
}

# What a report advises for the weakest metric, and for any other.
RECOMMENDATIONS = {
    "actionability": "Make instructions more specific and implementable with concrete steps",
    "coherence": "Improve step-by-step sequencing and logical flow between instructions",
    "domain_specificity": "Include more domain-specific terminology and context",
    "technological_specificity": "Add specific tools, APIs, and technical implementation details",
    "understandability_enhanced": "Simplify language, improve structure, and reduce cognitive load",
    "user_focus_enhanced": "Better preserve user intent and align with original prompt requirements",
}
RECOMMENDATION = "Focus on improving this metric"
