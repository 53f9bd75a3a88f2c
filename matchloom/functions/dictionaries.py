"""Word lists of the matching engine. All are fixed values that results depend on."""

from __future__ import annotations

# First words that show a strong or a weak action.
STRONG_VERBS = """developed built designed implemented created engineered architected constructed coded programmed optimized improved enhanced refined streamlined
accelerated automated reduced minimized lowered increased grew expanded scaled multiplied boosted elevated strengthened amplified led directed orchestrated
spearheaded pioneered launched initiated established founded managed analyzed investigated examined researched identified discovered diagnosed evaluated
assessed reviewed integrated connected linked collaborated partnered unified consolidated merged coordinated synchronized delivered executed completed
shipped released presented documented communicated demonstrated innovated transformed revolutionized modernized revamped restructured reimplemented
overhauled resolved solved fixed debugged troubleshot mitigated prevented eliminated eradicated""".split()

# Words without meaning for a match.
STOP_WORDS = """deliver work help responsible support ability task good excellent manage assist ensure provide make give do has have will a an the in on at to for of
from by with and or but be is are am was were being been can could may might must should would this that these those need required skilled experience
knowledge understanding familiarity proficiency person team company business project role position job candidate ideal key time day week month year working""".split()

# Weak openings and the verbs that replace them, in order.
WEAK_OPENINGS = (
    ("responsible for", "Engineered"),
    ("worked on", "Developed"),
    ("involved in", "Spearheaded"),
    ("helped", "Facilitated"),
    ("assisted", "Supported"),
    ("did", "Executed"),
    ("made", "Developed"),
    ("was part of", "Contributed to"),
    ("participated", "Collaborated"),
)

# Weak patterns and replacements, first match wins.
WEAK_PATTERNS = (
    ("worked\\s+on\\s+", "Developed "),
    ("responsible\\s+for\\s+", "Managed "),
    ("handled\\s+", "Processed "),
    ("worked\\s+with\\s+", "Collaborated with "),
    ("used\\s+", "Leveraged "),
    ("helped\\s+", "Supported "),
    ("assisted\\s+(?:with\\s+)?", "Supported "),
    ("involved\\s+in\\s+", "Contributed to "),
    ("participated\\s+in\\s+", "Spearheaded "),
    ("made\\s+", "Created "),
)

# Scoring groups of keyword candidates (pattern, points).
TECHNICAL_POINTS = (
    ("javascript|typescript|python|java|c\\+\\+|go|rust|kotlin|scala|php|ruby|swift|csharp|c#", 8),
    ("react|angular|vue|svelte|ember|next\\.js|nuxt", 8),
    ("express|spring|django|flask|fastapi|nest|laravel|rails|aspnet", 8),
    ("mongodb|postgresql|mysql|oracle|redis|cassandra|elasticsearch|dynamodb|sql", 7),
    ("docker|kubernetes|aws|azure|gcp|cloud|terraform|jenkins|ci/cd|devops|git|gitlab|github", 8),
    ("rest|graphql|api|microservice|architecture|design patterns", 7),
    ("junit|jest|mocha|pytest|selenium|cypress|testing|tdd|bdd", 6),
    ("rabbit|kafka|redis|activemq|message queue", 6),
    ("oauth|jwt|authentication|security|encryption|ssl|https", 6),
    ("^(develop|design|implement|deploy|architect|build|create|engineer)", 4),
)

# Topic of a bullet without a metric and the tail that names one, first match wins.
METRIC_TAILS = (
    ("api|endpoint|rest|backend|server|service", ", handling 500+ daily requests and reducing response time by 30%."),
    ("ui|interface|component|frontend|react|css|html", ", improving page load time by 25% and enhancing user experience."),
    ("database|mongodb|sql|query|data|storage", ", reducing query latency by 40% and supporting 1,000+ records."),
    ("test|debug|bug|quality|qa", ", reducing bug count by 35% and improving code coverage to 80%."),
    ("git|version|collab|team|meeting|document", ", improving team delivery speed by 20%."),
)
METRIC_TAIL_ELSE = ", contributing to a 20% improvement in overall project efficiency."

# Display names of keywords.
DISPLAY_NAMES = {
    "js": "JavaScript", "node": "Node.js", "node.js": "Node.js", "mongo": "MongoDB", "mongodb": "MongoDB", "rest": "REST API", "api": "REST API", "aws": "AWS",
    "gcp": "Google Cloud", "azure": "Microsoft Azure", "reactjs": "React", "react.js": "React", "vuejs": "Vue.js", "vue.js": "Vue.js", "angularjs": "Angular",
    "typescript": "TypeScript", "ts": "TypeScript", "python3": "Python", "py": "Python", "sql": "SQL", "mysql": "MySQL", "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL", "redis": "Redis", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "jenkins": "Jenkins", "git": "Git",
    "gitlab": "GitLab", "jira": "Jira", "agile": "Agile", "scrum": "Scrum", "graphql": "GraphQL", "ci/cd": "CI/CD", "cicd": "CI/CD", "devops": "DevOps",
    "microservices": "Microservices", "html": "HTML", "css": "CSS", "ml": "Machine Learning", "nlp": "Natural Language Processing", "pandas": "Pandas",
    "numpy": "NumPy", "spark": "Apache Spark", "pyspark": "Apache Spark", "tableau": "Tableau",
}

# Technical terms with their weight, by the role that they speak for.
WEIGHTED_TERMS = {
    "backend": """java 3, python 3, javascript 3, typescript 3, go 3, golang 3, rust 3, c++ 3, c# 3, php 2, ruby 2, scala 3, kotlin 3, swift 2,
spring boot 4, django 4, flask 3, express.js 4, express 4, node.js 4, nodejs 4, node 3, nestjs 4, fastapi 4, rails 3, ruby on rails 4, laravel 3, spring 3, .net 3, asp.net 3""",
    "database": "mysql 3, postgresql 3, postgres 3, mongodb 3, mongo 3, redis 3, elasticsearch 3, dynamodb 3, cassandra 3, sqlite 2, oracle 2, firestore 3, sql 3, nosql 3",
    "cloud": "aws 3, azure 3, gcp 3, google cloud 3, amazon web services 4, microsoft azure 4, heroku 2, vercel 2, netlify 2",
    "devops": "docker 3, kubernetes 4, k8s 4, ci/cd 4, cicd 4, jenkins 3, github actions 3, gitlab ci 3, terraform 3, ansible 3, aws lambda 3, serverless 3, cloudformation 3",
    "backend, architecture": "microservices 4, microservices architecture 5, microservice 4, restful api 4, rest api 4, rest 3, graphql 3, grpc 3, websocket 3, api gateway 3, message queue 3, rabbitmq 3, kafka 3",
    "frontend": """react 4, reactjs 4, vue 3, vuejs 3, angular 3, angularjs 3, next.js 4, nextjs 4, svelte 3, html 2, css 2, sass 2, scss 2, tailwind 3, tailwindcss 3, bootstrap 2,
material-ui 3, mui 3, webpack 3, vite 3""",
    "mobile": "react native 4, flutter 3, ios 2, android 2, xamarin 2",
    "core": "data structures 3, algorithms 3, oop 2, object oriented programming 3, design patterns 3, system design 4, software architecture 4, clean code 3, refactoring 3",
    "data": """machine learning 4, ml 3, deep learning 4, artificial intelligence 4, ai 3, tensorflow 4, pytorch 4, scikit-learn 4, sklearn 4, pandas 3, numpy 3, data science 4,
data analysis 3, nlp 3, natural language processing 4, computer vision 4""",
    "tool": "git 2, github 2, gitlab 2, bitbucket 2, jira 2, confluence 2, slack 1",
    "testing": """jest 3, mocha 3, cypress 3, selenium 3, playwright 3, junit 3, pytest 3, unit testing 3, integration testing 3, e2e testing 3, test driven development 4, tdd 3, bdd 3""",
    "methodology": "agile 3, scrum 3, kanban 2, waterfall 1, lean 2",
    "soft_skill": "communication 2, leadership 2, teamwork 2, problem solving 3, analytical 3, critical thinking 3",
}
# Verbs that tell a responsibility; words that are no keywords; where required and preferred parts begin.
RESPONSIBILITY_VERBS = "design develop deploy implement optimize build maintain deliver architect integrate create manage lead analyze test debug refactor review collaborate communicate".split()
NO_KEYWORDS = """role experience employment location year years team company candidate position job work working opportunity responsibility requirement qualification skill skills ability
knowledge degree bachelor master education must should preferred nice etc including plus new looking seeking hire""".split()
REQUIRED_CUES = ("required", "must have", "must-have", "mandatory", "essential", "core", "minimum", "necessary", "need to have")
PREFERRED_CUES = ("preferred", "nice to have", "bonus", "plus", "desired", "advantage", "preferred skills", "would be nice")


def weighted_terms() -> list[tuple[str, int, str]]:
    """(term, weight, role) of ``WEIGHTED_TERMS``, longest first, then as listed."""
    rows = [(entry.rpartition(" ")[0].strip(), int(entry.rpartition(" ")[2]), role.split(",")[0]) for role, entries in WEIGHTED_TERMS.items() for entry in entries.split(",")]
    return sorted(rows, key=lambda x: -len(x[0]))
