"""What a file is, from its path and its first characters: language, copies, output, tests, entries, licences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import tidy

# Languages of known names, of endings, of what runs a script, and endings of documents that hold no lines.
NAMES = {
    "makefile": "Make", "gnumakefile": "Make", "dockerfile": "Docker", "containerfile": "Docker", "justfile": "just", "rakefile": "Ruby", "gemfile": "Ruby", "brewfile": "Ruby",
    "vagrantfile": "Ruby", "jenkinsfile": "Groovy", "procfile": "Procfile", "cmakelists.txt": "CMake",
}
ENDINGS = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "rs": "Rust", "py": "Python", "go": "Go", "rb": "Ruby", "java": "Java", "kt": "Kotlin", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "cs": "C#",
    "ino": "Arduino", "pde": "Arduino", "cu": "CUDA", "cuh": "CUDA", "swift": "Swift", "php": "PHP", "css": "CSS", "scss": "SCSS", "html": "HTML", "vue": "Vue", "svelte": "Svelte",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "sql": "SQL", "prisma": "Prisma", "md": "Markdown", "sh": "Shell", "bash": "Shell", "flow": "Flow",
    "zig": "Zig", "lua": "Lua", "dart": "Dart", "scala": "Scala", "clj": "Clojure", "cljs": "Clojure", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "hs": "Haskell", "jl": "Julia", "r": "R", "nim": "Nim",
    "pl": "Perl", "pm": "Perl", "ps1": "PowerShell", "bat": "Batch", "cmd": "Batch", "zsh": "Shell", "fish": "Shell", "vb": "Visual Basic", "f90": "Fortran", "groovy": "Groovy", "gradle": "Gradle",
    "tf": "Terraform", "hcl": "HCL", "nix": "Nix", "proto": "Protobuf", "graphql": "GraphQL", "gql": "GraphQL", "sol": "Solidity", "astro": "Astro", "mdx": "MDX", "tex": "LaTeX", "adoc": "AsciiDoc", "rst": "reStructuredText",
    "txt": "Text", "snap": "Snapshot", "svg": "SVG", "xml": "XML", "csv": "CSV", "tsv": "CSV", "ini": "INI", "cfg": "INI", "conf": "INI", "properties": "INI", "plist": "XML", "bzl": "Starlark", "mk": "Make",
    "patch": "Patch", "diff": "Patch", "lock": "Lockfile", "ipynb": "Notebook",
}
RUNS = {"sh": "Shell", "bash": "Shell", "zsh": "Shell", "fish": "Shell", "python": "Python", "python3": "Python", "node": "JavaScript", "ruby": "Ruby", "perl": "Perl"}
DOCUMENTS = {
    "pdf": "PDF", "doc": "Word", "docx": "Word", "odt": "Word", "rtf": "Word", "xls": "Excel", "xlsx": "Excel", "xlsm": "Excel", "ods": "Excel", "ppt": "PowerPoint", "pptx": "PowerPoint", "odp": "PowerPoint",
    "png": "Image", "jpg": "Image", "jpeg": "Image", "gif": "Image", "webp": "Image", "ico": "Image", "bmp": "Image", "tiff": "Image", "avif": "Image", "heic": "Image",
    "mp4": "Video", "mov": "Video", "avi": "Video", "webm": "Video", "mkv": "Video", "mp3": "Audio", "wav": "Audio", "flac": "Audio", "ogg": "Audio", "m4a": "Audio",
    "zip": "Archive", "tar": "Archive", "gz": "Archive", "tgz": "Archive", "bz2": "Archive", "7z": "Archive", "rar": "Archive", "xz": "Archive",
    "ttf": "Font", "otf": "Font", "woff": "Font", "woff2": "Font", "eot": "Font", "psd": "Design", "ai": "Design", "sketch": "Design", "fig": "Design", "xd": "Design",
    "exe": "Binary", "dll": "Binary", "so": "Binary", "dylib": "Binary", "bin": "Binary", "o": "Binary", "class": "Binary", "jar": "Binary", "pyc": "Binary", "wasm": "WebAssembly",
    "db": "Database", "sqlite": "Database", "sqlite3": "Database", "mdb": "Database",
}
# Languages that a project is written in, folders of copies and of output, bundles, suites, what a framework loads.
CODE = ("TypeScript", "JavaScript", "Rust", "Python", "Go", "Ruby", "Java", "Kotlin", "C", "C++", "C#", "Swift", "PHP", "Dart", "Shell", "Vue", "Svelte", "Perl", "Groovy")
COPIES = r"(^|/)(node_modules|bower_components|jspm_packages|web_modules|vendor|vendored|third_party|thirdparty|Godeps|Pods|Carthage|\.yarn|\.pnp|\.gradle|\.tox|\.venv|venv|virtualenv|site-packages|__pycache__|\.mypy_cache|\.pytest_cache|eggs|\.eggs)/|(^|/)wwwroot/lib/|(^|/)[\w.-]*(theme|themes)/[\w.-]*/?(resources|static)/lib/"
OUTPUT = r"^(?:[^/]+/){0,2}(dist|build|out|target|coverage|\.next|\.nuxt|\.output|\.svelte-kit)/"
BUNDLED = r"(\.min\.[cm]?jsx?$)|(\.[0-9a-f]{8,}\.[cm]?jsx?$)|(^|/)[\w.-]*-build/"
RUNTIME = r"parcelRequire|webpackJsonp|__webpack_require__|System\.register|sourceMappingURL="
SUITE = r"(^|/)(test|tests|__tests__|spec|e2e)/|\.(test|spec)\.[jt]sx?$"
LOADED = r"(^|/)(page|layout|route|middleware|error|loading|not-found|template|default|head|sitemap|robots|manifest|icon|apple-icon|opengraph-image|twitter-image|instrumentation|_app|_document|\+page|\+layout|\+server)\.[jt]sx?$"
INDEXES, SERVED = r"(^|/)index\.[jt]sx?$", r"^(convex|functions|api|pages|app|src/app|src/pages|src/routes|routes)/"
# Licences by what their first 400 characters say, in this order.
LICENCES = (("MIT License", "MIT"), ("Apache License", "Apache-2.0"), ("GNU AFFERO", "AGPL-3.0"), ("GNU GENERAL PUBLIC", "GPL"), ("GNU LESSER", "LGPL"), ("BSD", "BSD"), ("Mozilla Public License", "MPL-2.0"), ("UNLICENSE|public domain", "Unlicense"))
# What is no route although it has a slash.
ASSET = r"(?i)\.(tsx?|jsx?|mjs|cjs|css|scss|less|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|md|mdx|html?|txt|map|wasm|zip|pdf|mp[34]|csv|ya?ml|toml|lock|sh|py|rb|go|rs|java|kt)$"
MIME = r"(?i)^(text|image|audio|video|application|multipart|font|model|message)/"
# Strings that a machine wrote, and which host a remote is on.
IDENTITY = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{16,}$|^[A-Za-z0-9+/]{24,}={0,2}$"
SIGNS = "0123456789 \t\n\x0b\f\r.,;:%#|/+_-"
DRAWN = r"^[MmLlHhVvCcSsQqTtAaZz][\d\s.,-]"
HOSTS = (("github.", "github"), ("gitlab.", "gitlab"), ("bitbucket.", "bitbucket"))


def _of(known: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ending(path: Column) -> Column:
    """What follows the name's last dot, lowered; '' where that dot begins the name."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def document_of(path: Column) -> Column:
    """The kind of a document that holds no lines; null for any other file."""
    return _of(DOCUMENTS, ending(path))


def language_of(path: Column, head: Column) -> Column:
    """The language by the whole name, else by its ending, else the ending itself, else by what runs it; '' if none says."""
    ran = F.regexp_extract(F.when(F.startswith(head, F.lit("#!")), F.left(head, F.lit(120))).otherwise(""), r"\b(fish|bash|zsh|sh|python3?|node|ruby|perl)\b", 1)
    end = ending(path)
    return F.coalesce(_of(NAMES, F.lower(base_name(path))), _of(ENDINGS, end), F.when(end != "", end), _of(RUNS, ran), F.lit(""))


def vendored(path: Column) -> Column:
    """Copies of others' code anywhere, build output in the three highest folders only."""
    return path.rlike(COPIES) | path.rlike(OUTPUT)


def glob_pattern(lines: Sequence[str]) -> str:
    """One pattern for all globs: / first ties one to the root, / last to a folder, ** crosses folders, # comments."""
    holes = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    found = []
    for line in lines:
        said = line.split("#", 1)[0].strip()
        if said:
            body = "".join(holes.get(piece) or re.escape(piece) for piece in re.split(r"(\*\*/|\*\*|\*|\?)", said.removeprefix("/")))
            found.append(("^" if said[0] == "/" else "(^|/)") + body + ("" if said[-1] == "/" else "(/|$)"))
    return "|".join(found)


def ignored(path: Column, lines: Sequence[str]) -> Column:
    """Whether a glob excludes the path; without any, nothing is."""
    pattern = glob_pattern(lines)
    return path.rlike(pattern) if pattern else F.lit(False)


def binary(head: Column) -> Column:
    """A null character among the first 8,192."""
    return F.contains(F.left(head, F.lit(8192)), F.lit("\0"))


def readable_source(path: Column, text: Column) -> Column:
    """Code that somebody wrote: no declarations, no bundle by name, marker or by lines of over 300 characters."""
    head = F.left(text, F.lit(4096))
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    long = (lines > 1) & (F.length(head) / lines > 300)
    return language_of(path, text).isin(*CODE) & ~path.rlike(r"\.d\.[cm]?ts$") & ~path.rlike(BUNDLED) & ~head.rlike(RUNTIME) & ~long


def in_suite(path: Column) -> Column:
    return path.rlike(SUITE)


def loaded_by_name(path: Column) -> Column:
    """Files that a framework loads by their name or place, so that nothing needs to call them."""
    return path.rlike(LOADED) | path.rlike(INDEXES) | path.rlike(SERVED)


def licence_said(text: Column) -> Column:
    """The licence that a licence file's first 400 characters name."""
    head, found = F.left(text, F.lit(400)), None
    for pattern, name in LICENCES:
        hit = head.rlike(f"(?i){pattern}")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("unknown")


def route_like(said: Column, named: bool = False) -> Column:
    """Whether a string is worth reading as a route; `named` for what a framework already calls one."""
    plain = (F.length(said) < (300 if named else 301)) & ~said.rlike(r"[\s\\]") & ~said.rlike(r"^\.{1,2}/")
    if named:
        return plain & ~said.rlike(ASSET) & (said.contains("/") | ~said.rlike(r"\w\.\w"))
    full = said.rlike(r"^(?:https?:)?//[^/?#]+")
    inner = said.contains("/") & ~said.rlike(r"^[A-Za-z]:/") & ~said.rlike(MIME)
    return (said != "") & plain & ~F.startswith(said, F.lit("~")) & ~said.rlike(ASSET) & (full | inner)


def machine_made(said: Column) -> Column:
    """Identifiers, drawn paths and strings of which more than 0.6 are digits and signs."""
    signs = F.length(said) - F.length(F.translate(said, SIGNS, ""))
    return said.rlike(IDENTITY) | said.rlike(DRAWN) | ((signs / F.length(said) > 0.6) & ~said.rlike(r"\s\w+\s\w+\s"))


def browsable(remote: Column) -> Column:
    """A remote's address as one for a browser; '' where there is none."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(remote, "^ssh://git@", "https://"), "^git@([^:]+):", "https://$1/"), "^git://", "https://"), r"\.git$", "")
    return F.when(F.startswith(url, F.lit("http")), url).otherwise("")


def remote_host(url: Column) -> Column:
    found = None
    for part, name in HOSTS:
        found = F.when(url.contains(part), name) if found is None else found.when(url.contains(part), name)
    return found.otherwise("git")


def tool_of(name: Column, email: Column, signers: Sequence[tuple[str, str]]) -> Column:
    """The first signer (pattern, label) that a name or address shows, else 'bot' for a bot's address, else ''."""
    found = F.when(F.lit(False), "")
    for pattern, label in signers:
        found = found.when(name.rlike(pattern) | email.rlike(pattern), label)
    return found.when(email.rlike(r"\[bot\]"), "bot").otherwise("")


def short_bytes(n: Column) -> Column:
    """A size in B, kB, MB or GB, one decimal from kB on."""
    scaled = lambda k: F.concat(F.format_string("%.1f", F.round(n / k, 1)), F.lit(" "))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 10**6, F.concat(scaled(1e3), F.lit("kB"))).when(n < 10**9, F.concat(scaled(1e6), F.lit("MB"))).otherwise(F.concat(scaled(1e9), F.lit("GB")))


def plain_letters(name: Column) -> Column:
    """Lowered letters and digits only, as names are compared."""
    return F.regexp_replace(F.lower(tidy(name)), "[^a-z0-9]", "")
