"""Types of the tables that the engine passes between its operators."""

from __future__ import annotations

PEAKS = "array<struct<mz:float,intensity:float>>"
#: One spectrum a row; scan_id counts all scans of the file, also those left out.
SCANS = f"sample_id string, scan_id int, level tinyint, rt double, precursor_mz double, iso_lo double, iso_hi double, peaks {PEAKS}"
TRACE = "array<struct<scan_id:int,rt:double,mz:double,intensity:double>>"
#: One chromatographic peak a row.
FEATURES = f"sample_id string, feature_id long, mz double, rt double, scan_id int, rt_start double, rt_end double, total_scans int, peak_height long, peak_area long, top_average long, gaussian_similarity double, noise_score double, asymmetry_factor double, trace {TRACE}"
#: Reference spectra; what has no column of its own is in ``extra``.
LIBRARY = "lib_id long, name string, precursor_mz double, precursor_type string, ion_mode string, retention_time double, formula string, smiles string, inchikey string, database string, peaks array<struct<mz:double,intensity:double>>, extra map<string,string>"
ALIGNED = "feature_id long, sample_id string, mz double, rt double, peak_height long, peak_area long, top_average long, is_gap_filled boolean"
EXPORTED_FEATURE_COLUMNS = ("group_ID feature_ID m/z RT adduct is_isotope is_in_source_fragment scan_idx peak_area peak_height top_average Gaussian_similarity noise_score asymmetry_factor charge isotopes RT_start RT_end total_scans peak_shape MS2 MS2_scan_id precursor_ion_fraction matched_MS2 search_mode annotation formula similarity matched_mz matched_peak_number SMILES InChIKey").split()
EXPORTED_ALIGNED_COLUMNS = ("group_ID feature_ID m/z RT adduct isotope_state is_isotope is_in_source_fragment scan_scan_cor Gaussian_similarity noise_score asymmetry_factor peak_shape detection_rate detection_rate_gap_filled alignment_reference_file isotopes MS2_reference_file MS2_scan_id MS2 precursor_ion_fraction matched_MS2 search_mode annotation formula similarity matched_peak_number SMILES InChIKey database").split()
