"""The Python data sources of the library."""

from helica.sources.bam import BamSource
from helica.sources.bcf import BcfSource
from helica.sources.cram import CramSource
from helica.sources.text_sources import BgzfLines, FastaSource, FastqSource

SOURCES = (BamSource, CramSource, BcfSource, BgzfLines, FastqSource, FastaSource)
