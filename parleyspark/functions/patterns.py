"""Pattern lists as data, and their portable forms.

Fixed values: the category, entity and title patterns below decide the results and stand here as they must be matched.
``\\b``, ``\\w`` and ``\\d`` mean ASCII, as in RE2 and in Python's re.ASCII.
"""

from __future__ import annotations

import re

# Fixed values: (category, pattern, case matters).
CATEGORIES: list[tuple[str, str, bool]] = [
    ("file_paths", r"(?:/[\w.-]+){2,}|[A-Z]:\\[\w\\.-]+|\b[\w-]+\.(?:ts|js|py|rs|go|java|tsx|jsx|css|html|json|yaml|yml|toml|md|sql|sh|bash|zsh|dockerfile|xml|csv|env|vue|svelte|rb|php|c|cpp|h|hpp|cs|swift|kt|scala|zig|wasm|prisma|graphql|proto)\b", False),
    ("cli_commands", r"\b(?:npm|npx|yarn|pnpm|pip|cargo|go|docker|kubectl|git|curl|wget|chmod|chown|mkdir|rm|cp|mv|ls|cat|grep|sed|awk|find|ssh|scp|tar|brew|apt|yum|dnf|pacman|make|cmake|gcc|rustc|javac|python|node|deno|bun)\s+[\w/.@-]+", False),
    ("code_keywords", r"\b(?:function|const|let|var|class|interface|type|enum|import|export|async|await|return|throw|try|catch|finally|if|else|for|while|switch|case|default|break|continue|new|this|super|extends|implements|abstract|static|public|private|protected|readonly|override|yield|def|fn|impl|struct|trait|match|pub|mod|use|from|as|with|lambda|self|None|True|False)\b", True),
    # the linear form of a nested repetition that matches the same strings
    ("code_identifiers", r"\b[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*\b", True),
    ("urls", r"https?://[\w.-]+[\w/\-?&=.%#@:]+", False),
    ("port_numbers", r"\b(?:localhost|127\.0\.0\.1|0\.0\.0\.0):(?:\d{2,5})\b|\bport\s+(?:\d{2,5})\b", False),
    ("api_endpoints", r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[\w/{}:.-]+|\b/api/[\w/{}:.-]+", False),
    ("sql_statements", r"\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|FROM|WHERE|JOIN|LEFT|RIGHT|INNER|OUTER|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|OFFSET|UNION|INDEX|TABLE|VIEW|TRIGGER|PRAGMA)\b", False),
    ("env_vars", r"\$\{?[A-Z][A-Z0-9_]+\}?|process\.env\.\w+|import\.meta\.env\.\w+", True),
    ("version_numbers", r"\bv?\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?(?:\+[\w.]+)?\b", True),
    ("doc_references", r"\b(?:README|CHANGELOG|LICENSE|CONTRIBUTING|TODO|FIXME|HACK|NOTE|IMPORTANT|DEPRECATED|@param|@returns?|@throws|@see|@example|@since|@deprecated|@author|@file|@description|@version)\b", False),
    ("definitions", r"\b(?:means?|refers?\s+to|is\s+(?:a|an|the)|defined\s+as|stands?\s+for|i\.e\.|e\.g\.|in\s+other\s+words|specifically|essentially|basically)\b", False),
    ("best_practices", r"\b(?:best\s+practice|recommend|should\s+(?:always|never|avoid)|anti[- ]?pattern|code\s+smell|convention|idiomatic|prefer|instead\s+of|avoid|trade[- ]?off|principle|pattern)\b", False),
    ("warnings", r"\b(?:warning|caution|careful|danger|risk|caveat|gotcha|pitfall|breaking\s+change|security\s+risk|vulnerability|deprecated|unsafe|do\s+not|don't|never|important\s+note)\b", False),
    ("prompt_patterns", r"\b(?:system\s+prompt|user\s+prompt|few[- ]?shot|zero[- ]?shot|chain[- ]?of[- ]?thought|CoT|in[- ]?context\s+learning|prompt\s+(?:injection|template|engineering)|role[- ]?play|persona|instruction[- ]?(?:tuning|following)|delimiters?|XML\s+tags?)\b", False),
    ("error_patterns", r"\b(?:TypeError|ReferenceError|SyntaxError|RangeError|URIError|EvalError|RuntimeError|ValueError|KeyError|ImportError|ModuleNotFoundError|AttributeError|FileNotFoundError|PermissionError|ConnectionError|TimeoutError|ENOENT|EACCES|ECONNREFUSED|EPERM|ERR_\w+|stack\s+trace|traceback|segfault|panic|unhandled\s+(?:rejection|exception))\b", True),
    ("package_names", r"\b@[\w-]+/[\w.-]+\b|(?:npm\s+(?:install|i)|yarn\s+add|pip\s+install|cargo\s+add)\s+[\w@/.-]+", True),
    ("git_operations", r"\bgit\s+(?:clone|init|add|commit|push|pull|fetch|merge|rebase|cherry[- ]?pick|stash|branch|checkout|switch|log|diff|status|reset|revert|tag|remote|submodule|worktree|bisect)\b", False),
    ("docker_ops", r"\b(?:dockerfile|docker[- ]?compose|podman|kubernetes|k8s|helm|FROM\s+\w+|WORKDIR|ENTRYPOINT|docker\s+(?:build|run|push|pull|exec|stop|rm|ps|images|volume|network|compose))\b", False),
    ("question_patterns", r"\b(?:how\s+(?:do|can|should|would|to)|what\s+(?:is|are|does|would)|why\s+(?:does|is|are|do|would|can't)|is\s+(?:it|there|this)|can\s+(?:you|I|we)|could\s+you|would\s+you|where\s+(?:is|are|do|does)|when\s+(?:should|do|does|is))\b", False),
]

# Fixed values: (entity type, pattern); case never matters.
ENTITIES: list[tuple[str, str]] = [
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("url", r"https?://[\w.-]+[\w/\-?&=.%#]+"),
    ("topic", r"\b(?:mcp|knowledge graph|rag|playwright|typescript|react|led|dmx|grandma|ma2|job|scraper|youtube|power query|cli|typing|crypto|whatsapp|invoice|automation|svg|visualization|api|github|copilot|skill|agent|docker|server|prompt|sequential thinking)\b"),
]

# Fixed value: openings of sentences that make no title.
BOILERPLATE = (
    r"(?i)^(?:I'll|I can|I will|I would|I'd be|Sure|Of course|Let me|Here'?s?|Certainly|Absolutely|Great|OK|Okay|Yes|No problem|Happy to|Glad to|Thank you|Thanks|The user (?:is|has|wants|said|asked|sent|provided|uploaded|shared)|The human (?:is|has|wants|said)|They'?re (?:asking|looking|want)|"
    r"This (?:is a|is small|appears|seems|looks|code)|First,? let'?s?|Now,? let'?s?|I need to (?:carefully|politely|analyze|search)|I found several|I should|However,? I|Looking at (?:the|this)|Based on (?:the|my)|From (?:your|the|my)|Let's (?:go|take|navigate|create)|Tool\"|Txt and paste)"
)

# Fixed value: words that carry no topic.
STOPWORDS = frozenset(
    """the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like
time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us
is are was were been has had did does doing am being should shall may might must need here very much more too still own such each tell set put made said let using please help file create add sure right""".split()
)

# Tool categories and the parts of tool names that belong to them.
TOOL_CATEGORIES = {
    "search": ["web_search", "brave_web_search", "web_fetch", "launch_extended_search_task", "launch_extended_search"],
    "code": ["execute_command", "write_file", "read_file", "bash_tool", "list_directory", "view", "repl", "bash"],
    "artifacts": ["artifacts"],
    "crypto": ["get_crypto_quote", "convert_crypto", "check_api_usage"],
    "reasoning": ["sequentialthinking"],
    "memory": ["create_entities", "create_relations", "add_observations", "read_graph", "search_nodes"],
    "filesystem": ["get_file_contents", "navigate_to_url"],
}

_W = "[A-Za-z0-9_]"
_ANY_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def java(pattern: str, case: bool = True) -> str:
    """The pattern for Java, where a word boundary would otherwise know letters beyond ASCII."""
    return ("" if case else "(?i)") + pattern.replace(r"\b", _ANY_EDGE)


def python(pattern: str, case: bool = True) -> re.Pattern:
    return re.compile(pattern, re.ASCII | (0 if case else re.IGNORECASE))


def re2(pattern: str, case: bool = True) -> str:
    """The pattern within a DuckDB string literal."""
    return (("" if case else "(?i)") + pattern).replace("'", "''")
