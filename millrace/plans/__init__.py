"""From statement text to DataFrames: lexer, parser, resolver, lowering."""
