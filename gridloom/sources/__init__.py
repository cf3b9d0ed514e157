"""Where documents come from and go to: files, byte decoding, listings, generators, the HTML tree."""
