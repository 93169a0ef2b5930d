"""The template language: text with ``{{ values }}`` and ``{% tags %}``, compiled to columns."""

from paperloom.lang.compiler import Compiler, Scope, render
from paperloom.lang.parser import ParseError, parse, show
from paperloom.lang.scanner import tokenize

__all__ = ["Compiler", "ParseError", "Scope", "parse", "render", "show", "tokenize"]
