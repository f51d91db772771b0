"""A clause is read to its real end, however long."""

from bibspark.llm import toxicity


def test_state_and_words_outlive_2000_characters():
    lexicon = frozenset({"=grub"})
    trigger, machine = toxicity.trigger_pattern(lexicon), toxicity.Grammar()
    read = lambda t: toxicity.measure(t, lexicon, trigger, machine).tolist()
    quoted = 'he said "a grub {} a grub" today. next'
    assert read(quoted.format("so " * 3)) == read(quoted.format("so " * 1500))
    word = "grub {}grub so on"
    assert all(read(word.format("x" * k + " ")) == read(word.format("xx ")) for k in range(1990, 2001))
