"""Where rows come from and go to: files by extension, text with a parser, live collections, object stores."""
