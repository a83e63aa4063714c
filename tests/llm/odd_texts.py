"""Awkward texts that every text operator must take."""
LONG = " ".join(f"w{i % 977} thnd, the" for i in range(60_000))
TEXTS = ["", "   \n\t ", None, "a", "one two", "The thnd, hein. It's THE <|endoftext|> end's x\x1cy İİ ẖ H̱.", "éclair naïve Straße 1234 \U0001f600 中文字",
         "same line\nsame line\n\n\nsame line\n x", "a b c d e f a b c d e f g h i", "###$$$ |||| <> &&", LONG, "word " * 4000]
