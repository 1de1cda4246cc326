"""The layers as composed DataFrame plans."""
