"""Column layouts of the engine's tables."""

from __future__ import annotations

#: What a record of a file says. tid is a number in the file's own dictionary of references, ref one over all inputs (the
#: number of the file, shifted by 32 bits, and tid; null without reference). mate: the mate's tid; raw: the record's own bytes
#: (a SAM line or a BAM record), null unless asked for.
RECORD = "file string, file_no int, ord long, qname string, flag int, tid int, ref long, pos long, end_pos long, qlen int, seq string, nm int, as_score int, xt int, xr int, mate int, raw binary"
#: A record with its reference's name and length.
ALIGNMENT = RECORD.replace("ref long, ", "ref long, rname string, ref_len long, ")

#: Output columns in order, spelled as users of such tables know them.
REFSTATS = "Length num_alns num_reads mean_readl stdev_readl median_readl mode_readl readl_min readl_max mean_alnnm mean_alnani stdev_alnani median_alnani num_covbases mean_cov breath_cov exp_breath breath_ratio mean_covcovered stdev_covcovered evenness_cov site_density duplicity entropy gini norm_entropy norm_gini tad80 mdust stdev_dust".split()
TAXSTATS = "taxid name num_accessions total_length num_alns num_reads mean_readl stdev_readl median_readl mode_readl readl_min readl_max mean_alnnm mean_alnani stdev_alnani median_alnani num_covbases mean_cov breath_cov exp_breath breath_ratio mean_covcovered stdev_covcovered evenness_cov site_density duplicity mdust stdev_dust".split()
BAMSTATS = "name aln tread mreadl vreadl mdreadl moreadl mani mnm tbases covbases covbreath".split()

#: Levels of ranks; every other rank is level 0. Fixed values.
RANKS = {"species": 0, "genus": 1, "family": 2, "order": 3, "class": 4, "phylum": 5, "kingdom": 6, "domain": 7}
