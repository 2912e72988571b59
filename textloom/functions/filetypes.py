"""Names for sets of file globs, and selections by them.

The built-in table is the usual one of line search tools; others come as definitions, which are a parameter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.globs import glob_regex

#: Each type's name and its globs.
# fmt: off
DEFAULT_TYPES = {
    "ada": ("*.adb", "*.ads"),
    "agda": ("*.agda", "*.lagda"),
    "aidl": ("*.aidl",),
    "alire": ("alire.toml",),
    "amake": ("*.mk", "*.bp"),
    "asciidoc": ("*.adoc", "*.asc", "*.asciidoc"),
    "asm": ("*.asm", "*.s", "*.S"),
    "asp": ("*.aspx", "*.aspx.cs", "*.aspx.vb", "*.ascx", "*.ascx.cs", "*.ascx.vb", "*.asp"),
    "ats": ("*.ats", "*.dats", "*.sats", "*.hats"),
    "avro": ("*.avdl", "*.avpr", "*.avsc"),
    "awk": ("*.awk",),
    "bat": ("*.bat",),
    "batch": ("*.bat",),
    "bazel": ("*.bazel", "*.bzl", "*.BUILD", "*.bazelrc", "BUILD", "MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel", "WORKSPACE.bzlmod"),
    "bitbake": ("*.bb", "*.bbappend", "*.bbclass", "*.conf", "*.inc"),
    "boxlang": ("*.bx", "*.bxm", "*.bxs"),
    "brotli": ("*.br",),
    "buildstream": ("*.bst",),
    "bzip2": ("*.bz2", "*.tbz2"),
    "c": ("*.[chH]", "*.[chH].in", "*.cats"),
    "cabal": ("*.cabal",),
    "candid": ("*.did",),
    "carp": ("*.carp",),
    "cbor": ("*.cbor",),
    "ceylon": ("*.ceylon",),
    "cfml": ("*.cfc", "*.cfm"),
    "clojure": ("*.clj", "*.cljc", "*.cljs", "*.cljx"),
    "cmake": ("*.cmake", "CMakeLists.txt"),
    "cmd": ("*.bat", "*.cmd"),
    "cml": ("*.cml",),
    "coffeescript": ("*.coffee",),
    "config": ("*.cfg", "*.conf", "*.config", "*.ini"),
    "coq": ("*.v",),
    "cpp": ("*.[ChH]", "*.cc", "*.[ch]pp", "*.[ch]xx", "*.hh", "*.inl", "*.[ChH].in", "*.cc.in", "*.[ch]pp.in", "*.[ch]xx.in", "*.hh.in"),
    "creole": ("*.creole",),
    "crystal": ("Projectfile", "*.cr", "*.ecr", "shard.yml"),
    "cs": ("*.cs",),
    "csharp": ("*.cs",),
    "cshtml": ("*.cshtml",),
    "csproj": ("*.csproj",),
    "css": ("*.css", "*.scss"),
    "csv": ("*.csv",),
    "cuda": ("*.cu", "*.cuh"),
    "cython": ("*.pyx", "*.pxi", "*.pxd"),
    "d": ("*.d",),
    "dart": ("*.dart",),
    "devicetree": ("*.dts", "*.dtsi", "*.dtso"),
    "dhall": ("*.dhall",),
    "diff": ("*.patch", "*.diff"),
    "dita": ("*.dita", "*.ditamap", "*.ditaval"),
    "docker": ("*Dockerfile*",),
    "dockercompose": ("docker-compose.yml", "docker-compose.*.yml"),
    "dts": ("*.dts", "*.dtsi"),
    "dvc": ("Dvcfile", "*.dvc"),
    "ebuild": ("*.ebuild", "*.eclass"),
    "edn": ("*.edn",),
    "elisp": ("*.el",),
    "elixir": ("*.ex", "*.eex", "*.exs", "*.heex", "*.leex", "*.livemd"),
    "elm": ("*.elm",),
    "erb": ("*.erb",),
    "erlang": ("*.erl", "*.hrl"),
    "fennel": ("*.fnl",),
    "fidl": ("*.fidl",),
    "fish": ("*.fish",),
    "flatbuffers": ("*.fbs",),
    "fortran": ("*.f", "*.F", "*.f77", "*.F77", "*.pfo", "*.f90", "*.F90", "*.f95", "*.F95"),
    "fsharp": ("*.fs", "*.fsx", "*.fsi"),
    "fut": ("*.fut",),
    "gap": ("*.g", "*.gap", "*.gi", "*.gd", "*.tst"),
    "gdscript": ("*.gd",),
    "gleam": ("*.gleam",),
    "gn": ("*.gn", "*.gni"),
    "go": ("*.go",),
    "gprbuild": ("*.gpr",),
    "gradle": ("*.gradle", "*.gradle.kts", "gradle.properties", "gradle-wrapper.*", "gradlew", "gradlew.bat"),
    "graphql": ("*.graphql", "*.graphqls"),
    "groovy": ("*.groovy", "*.gradle"),
    "gzip": ("*.gz", "*.tgz"),
    "h": ("*.h", "*.hh", "*.hpp"),
    "haml": ("*.haml",),
    "hare": ("*.ha",),
    "haskell": ("*.hs", "*.lhs", "*.cpphs", "*.c2hs", "*.hsc"),
    "hbs": ("*.hbs",),
    "hs": ("*.hs", "*.lhs"),
    "html": ("*.htm", "*.html", "*.ejs"),
    "hy": ("*.hy",),
    "idris": ("*.idr", "*.lidr"),
    "janet": ("*.janet",),
    "java": ("*.java", "*.jsp", "*.jspx", "*.properties"),
    "jinja": ("*.j2", "*.jinja", "*.jinja2"),
    "jl": ("*.jl",),
    "js": ("*.js", "*.jsx", "*.vue", "*.cjs", "*.mjs"),
    "json": ("*.json", "composer.lock", "*.sarif"),
    "jsonl": ("*.jsonl",),
    "julia": ("*.jl",),
    "jupyter": ("*.ipynb", "*.jpynb"),
    "k": ("*.k",),
    "kconfig": ("Kconfig", "Kconfig.*"),
    "kotlin": ("*.kt", "*.kts"),
    "lean": ("*.lean",),
    "less": ("*.less",),
    "license": ("COPYING", "COPYING[.-]*", "COPYRIGHT", "COPYRIGHT[.-]*", "EULA", "EULA[.-]*", "licen[cs]e", "licen[cs]e.*", "LICEN[CS]E", "LICEN[CS]E[.-]*", "*[.-]LICEN[CS]E*", "NOTICE", "NOTICE[.-]*", "PATENTS", "PATENTS[.-]*", "UNLICEN[CS]E", "UNLICEN[CS]E[.-]*", "agpl[.-]*", "gpl[.-]*", "lgpl[.-]*", "AGPL-*[0-9]*", "APACHE-*[0-9]*", "BSD-*[0-9]*", "CC-BY-*", "GFDL-*[0-9]*", "GNU-*[0-9]*", "GPL-*[0-9]*", "LGPL-*[0-9]*", "MIT-*[0-9]*", "MPL-*[0-9]*", "OFL-*[0-9]*"),
    "lilypond": ("*.ly", "*.ily"),
    "lisp": ("*.el", "*.jl", "*.lisp", "*.lsp", "*.sc", "*.scm"),
    "llvm": ("*.ll",),
    "lock": ("*.lock", "package-lock.json"),
    "log": ("*.log",),
    "lua": ("*.lua",),
    "lz4": ("*.lz4",),
    "lzma": ("*.lzma",),
    "m4": ("*.ac", "*.m4"),
    "make": ("[Gg][Nn][Uu]makefile", "[Mm]akefile", "[Gg][Nn][Uu]makefile.am", "[Mm]akefile.am", "[Gg][Nn][Uu]makefile.in", "[Mm]akefile.in", "Makefile.*", "*.mk", "*.mak"),
    "mako": ("*.mako", "*.mao"),
    "man": ("*.[0-9lnpx]", "*.[0-9][cEFMmpSx]"),
    "markdown": ("*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"),
    "matlab": ("*.m",),
    "md": ("*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"),
    "meson": ("meson.build", "meson_options.txt", "meson.options"),
    "minified": ("*.min.html", "*.min.css", "*.min.js"),
    "mint": ("*.mint",),
    "mk": ("mkfile",),
    "ml": ("*.ml",),
    "motoko": ("*.mo",),
    "msbuild": ("*.csproj", "*.fsproj", "*.vcxproj", "*.proj", "*.props", "*.targets", "*.sln", "*.slnf"),
    "nim": ("*.nim", "*.nimf", "*.nimble", "*.nims"),
    "nix": ("*.nix",),
    "objc": ("*.h", "*.m"),
    "objcpp": ("*.h", "*.mm"),
    "ocaml": ("*.ml", "*.mli", "*.mll", "*.mly"),
    "org": ("*.org", "*.org_archive"),
    "pants": ("BUILD",),
    "pascal": ("*.pas", "*.dpr", "*.lpr", "*.pp", "*.inc"),
    "pdf": ("*.pdf",),
    "perl": ("*.perl", "*.pl", "*.PL", "*.plh", "*.plx", "*.pm", "*.t"),
    "php": ("*.php", "*.php3", "*.php4", "*.php5", "*.php7", "*.php8", "*.pht", "*.phtml"),
    "po": ("*.po",),
    "pod": ("*.pod",),
    "postscript": ("*.eps", "*.ps"),
    "prolog": ("*.pl", "*.pro", "*.prolog", "*.P"),
    "protobuf": ("*.proto",),
    "ps": ("*.cdxml", "*.ps1", "*.ps1xml", "*.psd1", "*.psm1"),
    "puppet": ("*.epp", "*.erb", "*.pp", "*.rb"),
    "purs": ("*.purs",),
    "py": ("*.py", "*.pyi"),
    "python": ("*.py", "*.pyi"),
    "qmake": ("*.pro", "*.pri", "*.prf"),
    "qml": ("*.qml",),
    "qrc": ("*.qrc",),
    "qui": ("*.ui",),
    "r": ("*.R", "*.r", "*.Rmd", "*.rmd", "*.Rnw", "*.rnw"),
    "racket": ("*.rkt",),
    "raku": ("*.raku", "*.rakumod", "*.rakudoc", "*.rakutest", "*.p6", "*.pl6", "*.pm6"),
    "rdoc": ("*.rdoc",),
    "readme": ("README*", "*README"),
    "reasonml": ("*.re", "*.rei"),
    "red": ("*.r", "*.red", "*.reds"),
    "rescript": ("*.res", "*.resi"),
    "robot": ("*.robot",),
    "rst": ("*.rst",),
    "ruby": ("config.ru", "Gemfile", ".irbrc", "Rakefile", "*.gemspec", "*.rb", "*.rbw", "*.rake"),
    "rust": ("*.rs",),
    "sass": ("*.sass", "*.scss"),
    "scala": ("*.scala", "*.sbt"),
    "scdoc": ("*.scd", "*.scdoc"),
    "seed7": ("*.sd7", "*.s7i"),
    "sh": (".env", ".login", ".logout", ".profile", "profile", ".bash_login", "bash_login", ".bash_logout", "bash_logout", ".bash_profile", "bash_profile", ".bashrc", "bashrc", "*.bashrc", ".cshrc", "*.cshrc", ".kshrc", "*.kshrc", ".tcshrc", ".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc", "zshrc", "*.bash", "*.csh", "*.env", "*.ksh", "*.sh", "*.tcsh", "*.zsh"),
    "slim": ("*.skim", "*.slim", "*.slime"),
    "smarty": ("*.tpl",),
    "sml": ("*.sml", "*.sig"),
    "solidity": ("*.sol",),
    "soy": ("*.soy",),
    "spark": ("*.spark",),
    "spec": ("*.spec",),
    "sql": ("*.sql", "*.psql"),
    "ssa": ("*.ssa",),
    "stylus": ("*.styl",),
    "sv": ("*.v", "*.vg", "*.sv", "*.svh", "*.h"),
    "svelte": ("*.svelte", "*.svelte.ts"),
    "svg": ("*.svg",),
    "swift": ("*.swift",),
    "swig": ("*.def", "*.i"),
    "systemd": ("*.automount", "*.conf", "*.device", "*.link", "*.mount", "*.path", "*.scope", "*.service", "*.slice", "*.socket", "*.swap", "*.target", "*.timer"),
    "taskpaper": ("*.taskpaper",),
    "tcl": ("*.tcl",),
    "tex": ("*.tex", "*.ltx", "*.cls", "*.sty", "*.bib", "*.dtx", "*.ins"),
    "texinfo": ("*.texi",),
    "textile": ("*.textile",),
    "tf": ("*.tf", "*.tf.json", "*.tfvars", "*.tfvars.json", "*.terraformrc", "terraform.rc", "*.tfrc", "*.terraform.lock.hcl"),
    "thrift": ("*.thrift",),
    "toml": ("*.toml", "Cargo.lock"),
    "ts": ("*.ts", "*.tsx", "*.cts", "*.mts"),
    "twig": ("*.twig",),
    "txt": ("*.txt",),
    "typescript": ("*.ts", "*.tsx", "*.cts", "*.mts"),
    "typoscript": ("*.typoscript", "*.ts"),
    "typst": ("*.typ",),
    "usd": ("*.usd", "*.usda", "*.usdc"),
    "v": ("*.v", "*.vsh"),
    "vala": ("*.vala",),
    "vb": ("*.vb",),
    "vcl": ("*.vcl",),
    "verilog": ("*.v", "*.vh", "*.sv", "*.svh"),
    "vhdl": ("*.vhd", "*.vhdl"),
    "vim": ("*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc"),
    "vimscript": ("*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc"),
    "vue": ("*.vue",),
    "webidl": ("*.idl", "*.webidl", "*.widl"),
    "wgsl": ("*.wgsl",),
    "wiki": ("*.mediawiki", "*.wiki"),
    "xml": ("*.xml", "*.xml.dist", "*.dtd", "*.xsl", "*.xslt", "*.xsd", "*.xjb", "*.rng", "*.sch", "*.xhtml"),
    "xz": ("*.xz", "*.txz"),
    "yacc": ("*.y",),
    "yaml": ("*.yaml", "*.yml"),
    "yang": ("*.yang",),
    "z": ("*.Z",),
    "zig": ("*.zig",),
    "zsh": (".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc", "zshrc", "*.zsh"),
    "zstd": ("*.zst", "*.zstd"),
}
# fmt: on


class Types:
    """Definitions, changed in order: add("n:glob") or add("n:include:a,b"), clear(n), select(n), negate(n); "all" is every type."""

    def __init__(self, definitions: dict[str, Iterable[str]] | None = None):
        self.types = {k: list(v) for k, v in (DEFAULT_TYPES if definitions is None else definitions).items()}
        self.choices: list[tuple[bool, str]] = []

    def add(self, definition: str) -> Types:
        name, _, rest = definition.partition(":")
        if not name or not rest or not all(c.isalnum() for c in name) or name == "all":
            raise ValueError(f"not a type definition: {definition!r}")
        if rest.startswith("include:"):
            globs = [g for other in rest[8:].split(",") for g in self._globs(other)]
        else:
            globs = [rest]
        self.types.setdefault(name, []).extend(globs)
        return self

    def clear(self, name: str) -> Types:
        self.types.pop(name, None)
        return self

    def select(self, name: str) -> Types:
        return self._choose(True, name)

    def negate(self, name: str) -> Types:
        return self._choose(False, name)

    def _choose(self, take: bool, name: str) -> Types:
        # "all" are the types of this moment; what their globs are is asked at the end
        self.choices += [(take, n) for n in (sorted(self.types) if name == "all" else [name])]
        return self

    def _globs(self, name: str) -> list[str]:
        if name == "all":
            return [g for globs in self.types.values() for g in globs]
        if name not in self.types:
            raise ValueError(f"unknown type {name!r}")
        return self.types[name]

    def globs(self) -> list[tuple[str, bool, bool]]:
        """(regular expression of a name, whether it is taken in, false) of the selections' globs in their order."""
        return [(glob_regex(f"**/{g}"), take, False) for take, kind in self.choices for g in self._globs(kind)]

    def requires(self) -> bool:
        """Whether a file that no selection matches doesn't pass."""
        return any(take for take, _ in self.choices)

    def says(self, path: Column) -> Column:
        """What selections say of a file: its name's last match, null if none matches."""
        name = F.element_at(F.split(path, "/"), -1)
        out = F.lit(None).cast("boolean")
        for take, kind in self.choices:
            for g in self._globs(kind):
                out = F.when(name.rlike(glob_regex(g)), F.lit(take)).otherwise(out)
        return out

    def keeps(self, path: Column) -> Column:
        """Whether a file passes the selections: its name's last match wins; with a selection, a file that none matches doesn't pass."""
        return F.coalesce(self.says(path), F.lit(not self.requires()))

    def listing(self, spark: SparkSession) -> DataFrame:
        """(name, globs): the globs of each type, sorted and joined by a comma and a blank."""
        rows = spark.createDataFrame([(k, g) for k, v in self.types.items() for g in v] or [], "name string, glob string")
        return rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("glob")), ", ").alias("globs"))
