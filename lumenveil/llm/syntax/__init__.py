"""Grammars, lexers and the error-correcting chart parser behind the search for files that do not parse."""
